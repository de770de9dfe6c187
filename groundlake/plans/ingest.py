"""Registered queries over raw event lines: the events table written as JSON text, with faults at known places."""

from __future__ import annotations

from ..functions import identity
from ..functions.numbers import F
from ..operators import events as e
from .view import EXPRESSIONS as V

SECRET = b"groundlake"
_N = "event_id % 40"

#: One JSON line an event; the same text on either engine.
LINE = (
    "CASE {n} WHEN 19 THEN 'not json' WHEN 20 THEN '[1,2]' ELSE concat('{{\"event_id\":', CASE WHEN {n} = 1 THEN '\"\"' ELSE concat('\"E', CAST(event_id - event_id % 7 AS STRING), '\"') END,"
    " ',\"event_type\":', CASE WHEN {n} = 2 THEN '\"weird\"' WHEN {n} = 3 THEN 'null' ELSE concat('\"', {type}, '\"') END,"
    " ',\"timestamp\":\"', CASE WHEN {n} = 4 THEN 'yesterday' ELSE concat({date}, 'T', lpad(CAST({hour} AS STRING), 2, '0'), ':00:00Z') END, '\"',"
    " ',\"latency_ms\":', CASE WHEN {n} = 5 THEN '-10' WHEN {n} = 6 THEN '\"fast\"' WHEN {n} = 7 THEN 'true' ELSE concat(CAST(k AS STRING), '.5') END,"
    " ',\"language\":\"', CASE WHEN {n} = 8 THEN 'xx' ELSE {language} END, '\",\"script\":\"', CASE WHEN {n} = 9 THEN 'runic' ELSE {script} END, '\",\"provider\":\"', CASE WHEN {n} = 10 THEN 'acme' ELSE {provider} END, '\"',"
    " ',\"session_id\":\"', CASE WHEN {n} = 22 THEN '' WHEN {n} < 10 THEN concat('SES-LIVE', CAST(user_id AS STRING)) ELSE CAST(user_id AS STRING) END, '\"',"
    " CASE {n} WHEN 11 THEN ',\"telemetry_environment\":\"prod\"' WHEN 12 THEN ',\"telemetry_environment\":\"LIVE\"' WHEN 13 THEN ',\"raw_query\":\"x\"' WHEN 14 THEN ',\"note\":\"write to a.b@c.org\"' WHEN 15 THEN concat(',\"note\":\"', repeat('x', 201), '\"')"
    " WHEN 16 THEN ',\"note\":\"call 9876543210 now\"' WHEN 17 THEN ',\"note\":\"Bearer abc.def\"' WHEN 18 THEN concat(',\"fallback_reason\":\"', repeat('y', 300), '\"') WHEN 21 THEN ',\" Email \":1' WHEN 23 THEN ',\"candidate_count\":null' WHEN 24 THEN ',\"meta\":{{\"inner\":{{\"Password\":\"x\",\"list\":[{{\"note\":\"Bearer abc.def\"}},[{{\"secret\":1}}],\"e.f@g.org\"]}}}}'"
    " WHEN 25 THEN concat(',\"items\":[{{\"email\":\"a.b@c.org\"}},{{\"deep\":[{{\"reason\":\"', repeat('z', 201), '\"}}]}}]') WHEN 26 THEN concat(',\"meta\":{{\"source_path\":\"', repeat('p', 201), '\",\"call\":[{{\"me\":{{\"at\":\"9876543210\"}}}}]}}') ELSE concat(',\"candidate_count\":', CAST(k % 9 AS STRING)) END, '}}') END"
).format(n=_N, type=V["event_type"], date=V["date"], hour=V["hour"], language=V["language"], script=V["script"], provider=V["provider"])
COLUMNS = {"source_file": "concat('f', CAST(event_id % 3 AS STRING))", "line_number": "event_id", "line": LINE}
LINES_SQL = "lines AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in COLUMNS.items()) + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"


def lines(spark, sf_dir):
    keyed = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return keyed.selectExpr(*[f"{x} AS {n}" for n, x in COLUMNS.items()])


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _text(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN json_extract_string(j, '$.{name}') END"


def _is(name: str) -> str:
    return f"COALESCE(json_type(j, '$.{name}'), 'NULL') <> 'NULL'"


def _domain(name: str, allowed) -> str:
    return f"{_is(name)} AND NOT COALESCE(lower({_text(name)}) IN ({_list(allowed)}), false)"


_STAMP = f"COALESCE(NULLIF({_text('timestamp')}, ''), NULLIF({_text('timestamp_utc')}, ''))"
_NUMBER = "".join(f" WHEN {_is(n)} AND json_type(j, '$.{n}') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN '{n}: not a number' WHEN {_is(n)} AND CAST(json_extract_string(j, '$.{n}') AS DOUBLE) < 0 THEN '{n}: negative'" for n in e.NUMBERS)
_STRINGS = "list_sort(list_filter(json_keys(j), lambda k: json_type(j, concat('$.\"', k, '\"')) = 'VARCHAR' AND {}))"
_LONG = _STRINGS.format(f"length(json_extract_string(j, concat('$.\"', k, '\"'))) > 200 AND k NOT IN ({_list(e.LONG_ALLOWED)})")
_SENSITIVE = _STRINGS.format("regexp_matches(json_extract_string(j, concat('$.\"', k, '\"')), '" + "|".join(f"({p})" for p in e.PATTERNS.values()).replace("'", "''") + "')")
REASON = (
    "CASE WHEN j IS NULL THEN 'not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object'"
    f" WHEN list_has_any(list_transform(json_keys(j), lambda k: lower(trim(k))), [{_list(e.FORBIDDEN)}]) THEN 'forbidden field'"
    f" WHEN COALESCE({_text('event_type')}, '') = '' THEN 'event_type: missing' WHEN {_text('event_type')} NOT IN ({_list(e.EVENT_TYPES)}) THEN 'event_type: unsupported'"
    f" WHEN COALESCE({_text('event_id')}, '') = '' THEN 'event_id: missing' WHEN {_domain('telemetry_environment', e.ENVIRONMENTS)} THEN 'telemetry_environment: unsupported'"
    f" WHEN {_STAMP} IS NULL THEN 'timestamp: missing' WHEN TRY_CAST({_STAMP} AS TIMESTAMPTZ) IS NULL THEN 'timestamp: invalid'{_NUMBER}"
    f" WHEN {_domain('language', (*e.LANGUAGES, 'und'))} THEN 'language: unsupported' WHEN {_domain('script', e.SCRIPTS)} THEN 'script: unsupported' WHEN {_domain('provider', e.PROVIDERS)} THEN 'provider: unsupported'"
    f" WHEN len({_LONG}) > 0 THEN concat({_LONG}[1], ': too long') WHEN len({_SENSITIVE}) > 0 THEN concat({_SENSITIVE}[1], ': sensitive') END"
)
CHECKED = f"checked AS (SELECT *, {REASON} AS reason FROM (SELECT *, TRY_CAST(line AS JSON) AS j FROM lines))"
FIRST = f"firsts AS (SELECT *, {_text('event_id')} AS event_id FROM checked WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY {_text('event_id')} ORDER BY source_file, line_number) = 1)"


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([LINES_SQL, CHECKED, *ctes])} {body}"


def checked(spark, sf_dir):
    return e.validate(lines(spark, sf_dir))


def _flag(name: str, column, condition: str):
    """A single rule of the contract over all lines that are JSON."""
    def run(spark, sf_dir):
        return e.parsed(lines(spark, sf_dir)).filter("v IS NOT NULL").withColumn("texts", e._texts()).select("line_number", F.coalesce(column(), F.lit(False)).alias("broken"))

    return run, sql(f"SELECT line_number, COALESCE({condition}, false) AS broken FROM checked WHERE j IS NOT NULL")


def _hmac_sql(value: str) -> str:
    key = SECRET.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def normalized(spark, sf_dir):
    return e.normalize(e.first_occurrence(checked(spark, sf_dir)), SECRET)


def _got(name: str) -> str:
    return f"json_extract_string(j, '$.{name}')"


_USER = f"CASE WHEN trim(COALESCE({_got('session_id')}, '')) = '' THEN '' WHEN starts_with(trim({_got('session_id')}), 'USER-') AND length(trim({_got('session_id')})) <= 8 THEN trim({_got('session_id')}) ELSE concat('USER-', upper(substring({_hmac_sql('trim(' + _got('session_id') + ')')}, 1, 8))) END"
_ENV = f"COALESCE(NULLIF(lower({_got('telemetry_environment')}), ''), CASE WHEN {_got('event_type')} = 'query_completed' THEN 'fixture' WHEN starts_with(COALESCE({_got('session_id')}, ''), 'SES-LIVE') THEN 'live' ELSE 'test' END)"
NORMAL = (
    f"SELECT event_id, {_got('event_type')} AS event_type, {_ENV} AS telemetry_environment, {_got('timestamp')} AS timestamp, substring({_got('timestamp')}, 1, 10) AS date, CAST(substring({_got('timestamp')}, 12, 2) AS INT) AS hour, "
    f"{_USER} AS anonymous_user_id, ({_USER}) <> '' AS user_identity_available, trim(COALESCE({_got('session_id')}, '')) AS session_id, '' AS document_id, COALESCE({_got('language')}, 'und') AS language, COALESCE({_got('script')}, 'unknown') AS script, COALESCE({_got('provider')}, 'mock') AS provider, "
    f"CAST(1 AS INT) AS variant_count, CAST(COALESCE({_got('candidate_count')}, '0') AS INT) AS candidate_count, CAST({_got('latency_ms')} AS DOUBLE) AS latency_ms, CAST({_got('latency_ms')} AS DOUBLE) AS total_latency_ms, true AS grounded, true AS citation_valid, false AS fallback_used, COALESCE({_got('fallback_reason')}, '') AS fallback_reason FROM firsts"
)
NORMAL_COLUMNS = "event_id event_type telemetry_environment timestamp date hour anonymous_user_id user_identity_available session_id document_id language script provider variant_count candidate_count latency_ms total_latency_ms grounded citation_valid fallback_used fallback_reason".split()
#: Every field of every object, each level from the objects among the values of the last.
WALK = (
    "walk AS (SELECT source_file, line_number, 1 AS depth, field, json_extract(j, concat('$.\"', field, '\"')) AS value FROM (SELECT source_file, line_number, j, unnest(json_keys(j)) AS field FROM checked WHERE json_type(j) = 'OBJECT')"
    " UNION ALL SELECT source_file, line_number, depth + 1, field, json_extract(o, concat('$.\"', field, '\"')) FROM (SELECT source_file, line_number, depth, o, unnest(json_keys(o)) AS field FROM (SELECT source_file, line_number, depth, unnest(CASE json_type(value) WHEN 'OBJECT' THEN [value]"
    " WHEN 'ARRAY' THEN list_filter(CAST(value AS JSON[]), lambda x: json_type(x) = 'OBJECT') ELSE [] END) AS o FROM walk)))"
)


def walk_sql(body: str) -> str:
    return sql(body, WALK).replace("WITH", "WITH RECURSIVE", 1)


_VALUE = "CASE WHEN json_type(value) = 'VARCHAR' THEN json_extract_string(value, '$') END"
AUDIT = (
    f"SELECT source_file, line_number, field, unnest(list_filter([CASE WHEN lower(trim(field)) IN ({_list(e.FORBIDDEN)}) THEN 'forbidden_key' END, "
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in e.PATTERNS.items())
    + f", CASE WHEN length(text) > 200 AND field NOT IN ({_list(e.EXEMPT)}) THEN 'long_text' END], lambda x: x IS NOT NULL)) AS violation_type FROM (SELECT *, {_VALUE} AS text FROM walk)"
)
_PATTERN_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in e.PATTERNS.items())


def audited_table(spark, sf_dir):
    """Documents as a table with a forbidden column; every other text lies in a list of structs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = docs.select("doc_id", F.lit(1).alias("email"), F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.col("text").alias("body")))).alias("parts"))
    return e.audit_table(made, F.concat(F.lit("part "), (F.col("doc_id") % 3).cast("string")), F.col("doc_id"))


USER_ID = "CASE WHEN user_id % 17 = 0 THEN ' ' WHEN user_id % 5 = 0 THEN concat('USER-', CAST(user_id % 100 AS STRING)) ELSE concat('ನಾಗ', CAST(user_id AS STRING)) END"
SESSION_ID = "CASE WHEN user_id % 17 = 0 THEN '' WHEN user_id % 5 = 0 THEN concat('SES-', CAST(user_id AS STRING)) ELSE concat('session ', CAST(user_id AS STRING)) END"


def identities(make, expression):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", make(SECRET, F.expr(expression)).alias("anonymous_id"))


def _id_sql(prefix: str, x: str, alias: str) -> str:
    return f"SELECT event_id, CASE WHEN trim(x) = '' THEN NULL WHEN {alias} THEN trim(x) ELSE concat('{prefix}', upper(substring({_hmac_sql('trim(x)')}, 1, 8))) END AS anonymous_id FROM (SELECT event_id, {x} AS x FROM events)"


QUERIES = {
    "val01_validate": (lambda s, d: checked(s, d).select("source_file", "line_number", "reason"), sql("SELECT source_file, line_number, reason FROM checked")),
    "val02_not_object": _flag("val02", lambda: ~e.is_object(), "json_type(j) <> 'OBJECT'"),
    "val03_forbidden_key": _flag("val03", e.has_forbidden_key, f"json_type(j) = 'OBJECT' AND list_has_any(list_transform(json_keys(j), lambda k: lower(trim(k))), [{_list(e.FORBIDDEN)}])"),
    "val04_event_type": _flag("val04", lambda: ~F.coalesce(e.text("event_type").isin(*e.EVENT_TYPES), F.lit(False)), f"NOT COALESCE({_text('event_type')} IN ({_list(e.EVENT_TYPES)}), false)"),
    "val05_event_id": _flag("val05", lambda: F.coalesce(e.text("event_id"), F.lit("")) == "", f"COALESCE({_text('event_id')}, '') = ''"),
    "val06_environment": _flag("val06", lambda: e._domain("telemetry_environment", e.ENVIRONMENTS), _domain("telemetry_environment", e.ENVIRONMENTS)),
    "val07_timestamp": _flag("val07", lambda: F.try_to_timestamp(e._stamp()).isNull(), f"TRY_CAST({_STAMP} AS TIMESTAMPTZ) IS NULL"),
    "val08_numbers": _flag("val08", lambda: F.coalesce(*[e._number_fault(n) for n in e.NUMBERS]).isNotNull(), f"(CASE{_NUMBER} END) IS NOT NULL"),
    "val09_domains": _flag("val09", lambda: e._domain("language", (*e.LANGUAGES, "und")) | e._domain("script", e.SCRIPTS) | e._domain("provider", e.PROVIDERS), f"({_domain('language', (*e.LANGUAGES, 'und'))}) OR ({_domain('script', e.SCRIPTS)}) OR ({_domain('provider', e.PROVIDERS)})"),
    "val10_long_text": _flag("val10", lambda: e._first_text(lambda x: (F.length(x["value"]) > 200) & ~x["name"].isin(*e.LONG_ALLOWED), "").isNotNull(), f"len({_LONG}) > 0"),
    "val11_sensitive": _flag("val11", lambda: e._first_text(lambda x: x["value"].rlike("|".join(f"({p})" for p in e.PATTERNS.values())), "").isNotNull(), f"len({_SENSITIVE}) > 0"),
    "src02_quarantine": (
        lambda s, d: e.quarantine(checked(s, d)).withColumn("keys_present", F.array_join(F.array_sort("keys_present"), ",")),
        sql("SELECT source_file, line_number, reason, CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(json_keys(j)), ',') END AS keys_present, CASE WHEN j IS NULL THEN substring(line, 1, 100) END AS raw_content_preview FROM checked WHERE reason IS NOT NULL"),
    ),
    "wn12_first_occurrence": (lambda s, d: e.first_occurrence(checked(s, d)).select("event_id", "source_file", "line_number"), sql("SELECT event_id, source_file, line_number FROM firsts", FIRST)),
    "prj01_normalize": (lambda s, d: normalized(s, d).select(*NORMAL_COLUMNS), sql(NORMAL, FIRST)),
    "jb01_ingest_report": (lambda s, d: e.report(checked(s, d)), sql(f"SELECT COALESCE(reason, 'valid') AS outcome, CASE WHEN reason IS NULL THEN {_text('event_type')} END AS event_type, count(*) AS records, count(DISTINCT {_text('event_id')}) AS distinct_ids FROM checked GROUP BY ALL")),
    "jb02_lake_partitions": (lambda s, d: normalized(s, d).groupBy("telemetry_environment", "date", "event_type").agg(F.count("*").alias("records")), sql(f"SELECT telemetry_environment, date, event_type, count(*) AS records FROM ({NORMAL}) GROUP BY ALL", FIRST)),
    "jb04_privacy_audit": (lambda s, d: e.audit(lines(s, d)), walk_sql(AUDIT)),
    "jb04_audit_table": (audited_table, f"SELECT source_file, 0 AS line_number, 'email' AS field, 'forbidden_key' AS violation_type FROM (SELECT DISTINCT concat('part ', CAST(doc_id % 3 AS STRING)) AS source_file FROM documents) UNION ALL SELECT concat('part ', CAST(doc_id % 3 AS STRING)), doc_id, f, v FROM (SELECT doc_id, 'email' AS f, 'forbidden_key' AS v FROM documents UNION ALL SELECT doc_id, 'body', unnest(list_filter([{_PATTERN_HITS}, CASE WHEN length(text) > 200 THEN 'long_text' END], lambda x: x IS NOT NULL)) FROM documents WHERE doc_id % 2 = 0)"),
    "am05_nested_fields": (lambda s, d: e.fields_of(e.parsed(lines(s, d))).select("source_file", "line_number", "field", "depth"), walk_sql("SELECT source_file, line_number, field, depth FROM walk")),
    "ag35_audit_summary": (lambda s, d: e.audit_summary(e.audit(lines(s, d))), walk_sql(f"SELECT violation_type, count(*) AS violations, count(DISTINCT (source_file, line_number)) AS records FROM ({AUDIT}) GROUP BY ALL")),
    "id01_anonymous_user": (identities(identity.anonymous_user_id, USER_ID), _id_sql("USER-", USER_ID, "regexp_full_match(trim(x), 'USER-[0-9]{1,3}')")),
    "id02_anonymous_session": (identities(identity.anonymous_session_id, SESSION_ID), _id_sql("SES-", SESSION_ID, "starts_with(trim(x), 'SES-') AND length(trim(x)) <= 12")),
    "id03_content_hash": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash")), "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
}
