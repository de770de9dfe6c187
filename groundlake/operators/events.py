"""Raw events: validation with quarantine, deduplication, normalisation, privacy audit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import anonymous_user_id

# Domains, forbidden names and patterns of the event contract.
ENVIRONMENTS = ("live", "test", "fixture")
EVENT_TYPES = ("query_completed", "retrieval_completed", "rag_response", "error")
LANGUAGES = ("en", "hi", "kn", "te", "mixed", "unknown")
SCRIPTS = ("latin", "devanagari", "kannada", "telugu", "mixed", "unknown")
PROVIDERS = ("gemini", "groq", "ollama", "mock", "unknown")
NUMBERS = ("latency_ms", "retrieval_latency_ms", "reranking_latency_ms", "generation_latency_ms", "total_latency_ms", "best_retrieval_score", "candidate_count", "selected_chunk_count", "retrieved_chunk_count", "variant_count", "citation_count", "hour")
FORBIDDEN = (
    "query", "raw_query", "query_text", "user_query", "normalized_query", "prompt", "raw_prompt", "system_prompt", "answer", "answer_text", "generated_answer", "response_text", "generated_variants", "variants_text",
    "passage", "passages", "content", "text_content", "document_text", "chunk_text", "email", "phone", "token", "api_key", "password", "secret", "authorization", "cookie",
)
PATTERNS = {
    "email": r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b",
    "phone": r"\b(?:\+91[\-\s]?)?[6-9]\d{9}\b",
    "google_key": r"\bAIza[0-9A-Za-z-_]{35}\b",
    "bearer": r"\bBearer\s+[A-Za-z0-9\-\._~\+\/]+=*\b",
}
#: What a text must hold for a pattern to find anything; a phone number has ten digits.
NEEDED = {"email": "@", "phone": None, "google_key": "AIza", "bearer": "Bearer"}
LONG_ALLOWED = ("error_details", "fallback_reason")
EXEMPT = ("error_details", "fallback_reason", "source_parquet_path", "source_path", "output_directory")
MAX_TEXT = 200
#: Fields that rules name, but for the keys that are forbidden.
RULED = ("event_type", "event_id", "telemetry_environment", "timestamp", "timestamp_utc", *NUMBERS, "language", "script", "provider")
NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parsed(lines: DataFrame) -> DataFrame:
    """SRC2: with the line as a VARIANT ``v``, null where it isn't JSON."""
    return lines.withColumn("v", F.try_parse_json("line"))


def field(name: str) -> Column:
    """A top-level field; null if absent."""
    return F.variant_get("v", f"$.{name}", "variant")


def _opened(name: str) -> Column:
    """A field that a rule names, where ``fields`` holds them all: a line's fields are looked through once, not once a rule."""
    return F.col("fields")[name]


Field = Callable[[str], Column]


def kind(name: str, of: Field = field) -> Column:
    """Type of a top-level field; null if absent."""
    return F.schema_of_variant(of(name))


def text(name: str, of: Field = field) -> Column:
    """A top-level field if it is a string."""
    return F.when(kind(name, of) == "STRING", F.try_variant_get(of(name), "$", "string"))


def _present(name: str, of: Field = field) -> Column:
    return F.coalesce(kind(name, of), F.lit("VOID")) != "VOID"


def _telling() -> Column:
    """Whether a string of the line may be too long or sensitive. Without a backslash its strings stand in it letter by letter, between quotes."""
    within = [F.contains("line", F.lit(x)) for x in ("\\", *(x for x in NEEDED.values() if x))]
    phone = F.col("line").rlike("[6-9][0-9]{9}")
    return reduce(lambda a, b: a | b, within) | phone | F.col("line").rlike(f'"[^"]{{{MAX_TEXT + 1}}}')


def _texts() -> Column:
    """Names and values of the top-level strings."""
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    strings = F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    return F.transform(strings, lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("value")))


def is_object() -> Column:
    """VAL2."""
    return F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))


def has_forbidden_key() -> Column:
    """VAL3."""
    names = F.transform(F.json_object_keys("line"), lambda k: F.lower(F.trim(k)))
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, FORBIDDEN))), F.lit(False))


def _domain(name: str, allowed: tuple[str, ...], of: Field = field) -> Column:
    """VAL6, VAL9: an optional string of a domain, in any case; true where the rule is broken."""
    return _present(name, of) & ~F.coalesce(F.lower(text(name, of)).isin(*allowed), F.lit(False))


def _stamp(of: Field = field) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(text("timestamp", of)), blank(text("timestamp_utc", of)))


def _number_fault(name: str, of: Field = field) -> Column:
    """VAL8: ``number`` if it isn't one, ``negative`` if it is below zero or not a number at all."""
    value = F.try_variant_get(of(name), "$", "double")
    bad = F.when(~kind(name, of).rlike(NUMERIC), F.lit(f"{name}: not a number")).when((value < 0) | F.isnan(value), F.lit(f"{name}: negative"))
    return F.when(_present(name, of), bad)


def _first_text(condition, reason: str) -> Column:
    """VAL10, VAL11: the first string, by name, that the condition holds for."""
    names = F.array_sort(F.transform(F.filter(F.col("texts"), condition), lambda e: e["name"]))
    return F.when(F.size(names) > 0, F.concat(names[0], F.lit(f": {reason}")))


def first_fault() -> Column:
    """VAL1: the first broken rule, in the order of the contract; null for a valid event. Reads ``fields``, ``stamp`` and ``texts`` of ``validate``."""
    rule = lambda broken, reason: F.when(broken, F.lit(reason))
    sensitive = lambda e: reduce(lambda a, b: a | b, [e["value"].rlike(p) for p in PATTERNS.values()])
    return F.coalesce(
        rule(F.col("v").isNull(), "not JSON"),
        rule(F.col("fields").isNull(), "not an object"),
        rule(has_forbidden_key(), "forbidden field"),
        rule(F.coalesce(text("event_type", _opened), F.lit("")) == "", "event_type: missing"),
        rule(~text("event_type", _opened).isin(*EVENT_TYPES), "event_type: unsupported"),
        rule(F.coalesce(text("event_id", _opened), F.lit("")) == "", "event_id: missing"),
        rule(_domain("telemetry_environment", ENVIRONMENTS, _opened), "telemetry_environment: unsupported"),
        rule(F.col("stamp").isNull(), "timestamp: missing"),
        rule(F.try_to_timestamp("stamp").isNull(), "timestamp: invalid"),
        *[_number_fault(n, _opened) for n in NUMBERS],
        rule(_domain("language", (*LANGUAGES, "und"), _opened), "language: unsupported"),
        rule(_domain("script", SCRIPTS, _opened), "script: unsupported"),
        rule(_domain("provider", PROVIDERS, _opened), "provider: unsupported"),
        _first_text(lambda e: (F.length(e["value"]) > MAX_TEXT) & ~e["name"].isin(*LONG_ALLOWED), "too long"),
        _first_text(sensitive, "sensitive"),
    )


def validate(lines: DataFrame) -> DataFrame:
    """``lines`` (source_file, line_number, line) with ``reason``: null for a valid event.

    The empty end of ``reason`` comes from a random draw: filters on it then stay above, and the rules are worked out once a line.
    """
    once = F.repeat(F.lit("-"), F.floor(F.rand()).cast("int"))
    fields = F.try_variant_get("v", "$", f"struct<{', '.join(f'{n}: variant' for n in RULED)}>")
    opened = parsed(lines).withColumn("fields", fields).withColumns({"stamp": _stamp(_opened), "texts": F.when(_telling(), _texts())})
    return opened.withColumn("reason", F.concat(first_fault(), once)).drop("fields", "stamp", "texts")


def details() -> list[Column]:
    """What is kept of a rejected event, without its content: reason, names of keys, and 100 characters of lines that weren't JSON."""
    keys = F.when(F.col("reason").isNotNull() & is_object(), F.json_object_keys("line"))
    preview = F.when(F.col("v").isNull(), F.substring("line", 1, 100))
    return [F.col("source_file"), F.col("line_number"), F.col("reason"), keys.alias("keys_present"), preview.alias("raw_content_preview")]


def quarantine(checked: DataFrame) -> DataFrame:
    """Rejected events without their content; see ``details``."""
    return checked.filter("reason IS NOT NULL").select(*details())


def first_occurrence(checked: DataFrame) -> DataFrame:
    """WN12: valid events, the first of each event_id by file and line."""
    order = Window.partitionBy("event_id").orderBy("source_file", "line_number")
    valid = checked.filter("reason IS NULL").withColumn("event_id", text("event_id"))
    return valid.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def derived_environment(event_type: Column, query_id: Column, session_id: Column) -> Column:
    """PRJ2: where an event that doesn't say comes from."""
    fixture = (event_type == "query_completed") | F.coalesce(query_id, F.lit("")).startswith("Q-FIX")
    return F.when(fixture, "fixture").when(F.coalesce(session_id, F.lit("")).startswith("SES-LIVE"), "live").otherwise("test")


def normalize(events: DataFrame, secret: bytes) -> DataFrame:
    """PRJ1-PRJ4: the 39 columns of the lake from VARIANT ``v``, with defaults; nulls take the default too."""
    get = lambda name, kind_="string": F.try_variant_get("v", f"$.{name}", kind_)
    blank = lambda c: F.when(F.trim(c) != "", c)
    s = lambda name, default="": F.coalesce(get(name), F.lit(default)).alias(name)
    n = lambda default, *names: F.coalesce(*[get(x, "int") for x in names], F.lit(default)).alias(names[0])
    d = lambda *names: F.coalesce(*[get(x, "double") for x in names], F.lit(0.0)).alias(names[0])
    b = lambda default, *names: F.coalesce(*[get(x, "boolean") for x in names], F.lit(default)).alias(names[0])
    stamp = F.coalesce(blank(get("timestamp")), blank(get("timestamp_utc")))
    environment = F.coalesce(blank(F.lower(get("telemetry_environment"))), derived_environment(get("event_type"), get("query_id"), get("session_id")))
    given, session = blank(F.trim(F.coalesce(blank(get("anonymous_user_id")), get("user_id")))), F.trim(F.coalesce(get("session_id"), F.lit("")))
    user = F.coalesce(given, anonymous_user_id(secret, get("session_id")), F.lit(""))
    return events.select(
        s("schema_version", "1.0"), s("event_id"), s("event_type", "unknown"), environment.alias("telemetry_environment"), stamp.alias("timestamp"),
        F.coalesce(blank(get("date")), F.substring(stamp, 1, 10)).alias("date"), F.coalesce(get("hour", "int"), F.expr("try_cast(substring(coalesce(try_variant_get(v, '$.timestamp', 'string'), try_variant_get(v, '$.timestamp_utc', 'string')), 12, 2) AS INT)"), F.lit(0)).alias("hour"),
        s("request_id_hash"), user.alias("anonymous_user_id"), (user != "").alias("user_identity_available"), session.alias("session_id"),
        F.coalesce(blank(get("document_id")), blank(get("top_doc_id")), F.lit("")).alias("document_id"), s("query_id"), s("retrieval_id"), s("language", "und"), s("previous_language"), s("script", "unknown"), s("query_type", "cross_lingual_fact"),
        b(False, "is_code_mixed"), b(False, "is_romanized"), n(1, "variant_count"), n(0, "candidate_count"), n(0, "retrieved_chunk_count", "selected_chunk_count"), n(0, "selected_chunk_count", "retrieved_chunk_count"),
        d("best_retrieval_score"), d("latency_ms", "total_latency_ms"), d("retrieval_latency_ms"), d("reranking_latency_ms"), d("generation_latency_ms"), d("total_latency_ms", "latency_ms"),
        s("provider", "mock"), s("answer_mode", "grounded"), b(False, "fallback_used"), s("fallback_reason"), n(0, "citation_count"), b(True, "citation_valid"), b(True, "grounded", "answer_grounded"), b(False, "error"), s("error_type"),
    )


def report(checked: DataFrame) -> DataFrame:
    """AG26: counts by outcome; duplicates are valid lines that aren't the first of their id."""
    outcome = F.coalesce("reason", F.lit("valid"))
    kind_ = F.when(F.col("reason").isNull(), text("event_type"))
    return checked.groupBy(outcome.alias("outcome"), kind_.alias("event_type")).agg(F.count("*").alias("records"), F.countDistinct(text("event_id")).alias("distinct_ids"))


def _object(v: Column) -> Column:
    """A VARIANT's fields; null if it isn't an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _objects(v: Column) -> Column:
    """The object a VARIANT is, or the objects among its items if it is a list."""
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: _object(x).isNotNull())
    return F.when(_object(v).isNotNull(), F.array(v)).otherwise(F.coalesce(items, F.array().cast("array<variant>")))


def fields_of(records: DataFrame, record: str = "v") -> DataFrame:
    """AM5: ``field``, ``value`` (VARIANT) and ``depth`` of every field of ``record`` and of all objects in it, at any depth.

    Objects are met as values of fields and as items of lists. A record that is no object has no fields. Each level of a record opens the
    next one within its row; there are no more levels than brackets in its text. Other columns stay.
    """
    kind_ = "array<struct<field:string, value:variant, depth:int>>"

    def deeper(state: Column, depth: Column) -> Column:
        of = lambda o: F.transform(F.map_entries(_object(o)), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), depth.cast("int").alias("depth")))
        new = F.flatten(F.transform(state["open"], of))
        return F.struct(F.concat(state["found"], new).alias("found"), F.flatten(F.transform(new, lambda e: _objects(e["value"]))).alias("open"))

    levels = F.sequence(F.lit(1), F.length(F.regexp_replace(F.to_json(record), r"[^\[{]", "")) + 1)
    start = F.struct(F.array().cast(kind_).alias("found"), F.when(_object(F.col(record)).isNotNull(), F.array(record)).otherwise(F.array().cast("array<variant>")).alias("open"))
    return records.withColumn("found", F.explode(F.aggregate(levels, start, deeper, lambda state: state["found"]))).select("*", "found.*").drop("found")


def _violations(records: DataFrame, exempt: tuple[str, ...]) -> DataFrame:
    rows = fields_of(records.select("source_file", "line_number", "v")).withColumn("value", F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")))
    hits = [F.when(F.lower(F.trim("field")).isin(*FORBIDDEN), F.lit("forbidden_key")), *(F.when(F.col("value").rlike(p), F.lit(name)) for name, p in PATTERNS.items())]
    hits.append(F.when((F.length("value") > MAX_TEXT) & ~F.col("field").isin(*exempt), F.lit("long_text")))
    return rows.select("source_file", "line_number", "field", F.explode(F.array_compact(F.array(*hits))).alias("violation_type"))


def audit(lines: DataFrame, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """JB4: a row for each privacy violation in (source_file, line_number, line): forbidden key, sensitive value, long text, at any depth.

    Lines that aren't JSON, or no object, have none; fields of the ``exempt`` names may be long.
    """
    return _violations(parsed(lines), exempt)


def audit_documents(files: DataFrame, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """JB4 for whole JSON files (source_file, text): one record, or a list of them, which are numbered from 1."""
    rows = files.withColumn("v", F.try_parse_json("text"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    return _violations(rows.select("source_file", F.posexplode(F.coalesce(listed, F.array("v"))).alias("line_number", "v")).withColumn("line_number", F.col("line_number") + 1), exempt)


def audit_table(rows: DataFrame, source_file: Column, row_number: Column, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """JB4 for a table: each forbidden column name once a file at row 0, then what ``audit`` says of its rows and all that is nested in them.

    ``source_file`` and ``row_number`` say where a row comes from, for Parquet ``F.col("_metadata.file_name")`` and
    ``F.col("_metadata.row_index") + 1``.
    """
    names = [n for n in rows.columns if n.lower() in FORBIDDEN]
    placed = rows.select(source_file.alias("source_file"), row_number.alias("line_number"), F.to_variant_object(F.struct(*rows.columns)).alias("v"))
    found = _violations(placed, exempt)
    if not names:
        return found
    columns = placed.select("source_file").distinct().select("source_file", F.lit(0).alias("line_number"), F.explode(F.array(*map(F.lit, names))).alias("field"), F.lit("forbidden_key").alias("violation_type"))
    return columns.unionByName(found)


def audit_summary(violations: DataFrame) -> DataFrame:
    """AG35."""
    return violations.groupBy("violation_type").agg(F.count("*").alias("violations"), F.countDistinct("source_file", "line_number").alias("records"))
