"""Metric tables over the event lake, for each environment and for all of them in one pass.

Each function takes the lake (see schemas in ``sources.lake``) and returns a table with a column
``environment``: live, test, fixture or all. Grouping sets make the last from the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean, percent, rounded
from .quantiles import with_percentiles

ENV = "telemetry_environment"
QUERY_TYPES = ("query_completed", "rag_response")
#: Display names of languages.
LANGUAGE_NAMES = {"en": "English", "hi": "हिन्दी (Hindi)", "kn": "ಕನ್ನಡ (Kannada)", "te": "తెలుగు (Telugu)"}
REQUIRED_LANGUAGES = ("en", "hi", "kn", "te")
PROFILES = ("English Only", "English + Hindi", "English + Kannada", "English + Telugu", "Multilingual (3+ Languages)", "Code-Mixed & Romanized")


def per_environment(df: DataFrame, keys: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """AG1: group by environment and keys, and by the keys alone as environment ``all``."""
    grouped = df.groupingSets([[ENV, *keys], list(keys)], ENV, *keys)
    named = F.when(F.grouping(ENV) == 1, "all").otherwise(F.col(ENV))
    out = grouped.agg(named.alias("environment"), *aggregates)
    return out.select("environment", *keys, *out.columns[len(keys) + 2 :])


def _everywhere(rows: DataFrame) -> DataFrame:
    """Rows twice: under their environment and under ``all``."""
    return rows.withColumn("environment", F.explode(F.array(F.col(ENV), F.lit("all"))))


def queries(lake: DataFrame) -> DataFrame:
    return lake.filter(F.col("event_type").isin(*QUERY_TYPES))


def identified(lake: DataFrame) -> DataFrame:
    return lake.filter(F.col("anonymous_user_id").isNotNull() & (F.col("anonymous_user_id") != ""))


def errors(lake: DataFrame) -> DataFrame:
    return lake.filter(F.col("error") | (F.col("event_type") == "error"))


def _share(count: str, by: str = "environment") -> Column:
    """WN11: of all rows of the environment."""
    return percent(F.col(count), F.sum(count).over(Window.partitionBy(by)), 1)


def _n(condition: str | Column) -> Column:
    return F.count_if(F.col(condition) if isinstance(condition, str) else condition)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(names[code], F.upper(code))


def status_band(rate: Column) -> Column:
    """PRJ12."""
    return F.when(rate >= 80, "Excellent").when(rate >= 60, "Good").otherwise("Needs Attention")


def volume(lake: DataFrame, key: str) -> DataFrame:
    """AG2-AG4: events by type, date or hour."""
    return per_environment(lake, (key,), F.count("*").alias("events"))


def headline(lake: DataFrame) -> DataFrame:
    """AG5: one row of counts by type; a type that is absent counts 0."""
    kind = lambda t: _n(F.col("event_type") == t).alias(f"{t}_count")
    return per_environment(lake, (), F.count("*").alias("total_records"), *map(kind, ("query_completed", "retrieval_completed", "rag_response", "error")))


def users(lake: DataFrame) -> DataFrame:
    """AG6: what each identified user asked."""
    documents = F.size(F.filter(F.collect_set("document_id"), lambda d: F.trim(d) != ""))  # AM2
    out = per_environment(
        identified(queries(lake)),
        ("anonymous_user_id",),
        F.count("*").alias("query_count"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages_used"),  # AM1
        documents.cast("bigint").alias("documents_accessed"),
        _n("grounded").alias("g"),
        _n("fallback_used").alias("f"),
        mean("total_latency_ms").alias("l"),
    )
    rate = lambda c: percent(F.col(c), F.col("query_count"), 1)
    return out.select("environment", "anonymous_user_id", "query_count", "languages_used", "documents_accessed", rate("g").alias("grounded_rate"), rate("f").alias("fallback_rate"), rounded(F.coalesce("l", F.lit(0.0)), 1).alias("avg_latency_ms"))


def top_users(lake: DataFrame, k: int = 25) -> DataFrame:
    """SO1: the k users with most queries, ties by name."""
    place = Window.partitionBy("environment").orderBy(F.desc("query_count"), "anonymous_user_id")
    return users(lake).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def user_profiles(lake: DataFrame) -> DataFrame:
    """AG7: identified users by their languages; every profile has a row."""
    each = per_environment(
        identified(queries(lake)),
        ("anonymous_user_id",),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("langs"),
        (_n("is_code_mixed") / F.count("*")).alias("mixed"),
    )
    langs = F.col("langs")
    profile = (
        F.when(F.col("mixed") >= 0.4, PROFILES[5]).when(langs == "en", PROFILES[0])
        .when(langs.isin("en,hi", "hi"), PROFILES[1]).when(langs.isin("en,kn", "kn"), PROFILES[2])
        .when(langs.isin("en,te", "te"), PROFILES[3]).otherwise(PROFILES[4])
    )
    counts = each.withColumn("profile", profile).groupBy("environment", "profile").agg(F.count("*").alias("n"))
    padded = counts.select("environment").distinct().withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES)))).join(counts, ["environment", "profile"], "left")
    padded = padded.select("environment", "profile", F.coalesce("n", F.lit(0)).alias("user_count"))
    return padded.withColumn("percentage", _share("user_count"))


def daily_active(lake: DataFrame) -> DataFrame:
    """AG8: an empty user id counts as one user, and a day has at least one."""
    active = F.greatest(F.countDistinct("anonymous_user_id"), F.lit(1))
    return per_environment(queries(lake), ("date",), active.alias("active_users"), F.count("*").alias("queries"))


def user_summary(lake: DataFrame) -> DataFrame:
    """Users and average queries per user: all queries, anonymous ones too, over identified users."""
    known = F.when((F.col("anonymous_user_id") != ""), F.col("anonymous_user_id"))
    out = per_environment(queries(lake), (), F.count("*").alias("total_queries"), F.countDistinct(known).alias("total_unique_users"))
    average = F.when(F.col("total_unique_users") > 0, rounded(F.col("total_queries") / F.col("total_unique_users"), 2)).otherwise(0.0)
    return out.withColumn("avg_queries_per_user", average)


def language_performance(lake: DataFrame) -> DataFrame:
    """AG9: the language matrix in one aggregation."""
    out = per_environment(
        queries(lake),
        ("language",),
        F.count("*").alias("total_queries"),
        mean("total_latency_ms").alias("a"),
        mean("retrieval_latency_ms").alias("r"),
        mean("generation_latency_ms").alias("w"),
        _n("grounded").alias("g"),
        _n("citation_valid").alias("c"),
        _n("fallback_used").alias("f"),
        _n("is_code_mixed").alias("code_mixed_count"),
        _n("is_romanized").alias("romanized_count"),
        mean("retrieved_chunk_count").alias("k"),
        mean("citation_count").alias("n"),
    )
    out = with_percentiles(out, _everywhere(queries(lake)), ("environment", "language"), {"p": ("total_latency_ms", 0.95)})
    rate = lambda c: percent(F.col(c), F.col("total_queries"), 1)
    value = lambda c, d: rounded(F.coalesce(c, F.lit(0.0)), d)
    return out.select(
        "environment", "language", language_name(F.col("language")).alias("language_name"), "total_queries",
        _share("total_queries").alias("query_share_pct"), rate("g").alias("grounded_rate"), rate("c").alias("citation_validity_rate"), rate("f").alias("fallback_rate"),
        value("a", 1).alias("avg_total_latency_ms"), value("p", 1).alias("p95_total_latency_ms"), value("r", 2).alias("avg_retrieval_latency_ms"), value("w", 1).alias("avg_generation_latency_ms"),
        value("k", 2).alias("avg_retrieved_chunks"), value("n", 2).alias("avg_citations"), "code_mixed_count", rate("code_mixed_count").alias("code_mixed_rate"), "romanized_count",
        status_band(rate("g")).alias("status"),
    )


def providers(lake: DataFrame, *by: str) -> DataFrame:
    """AG10, AG22: events by provider, overall or per language."""
    return per_environment(queries(lake), (*by, "provider"), F.count("*").alias("events"))


def padded_languages(lake: DataFrame) -> DataFrame:
    """AG11: the required languages have a row each, with zeros where nothing was asked."""
    seen = language_performance(lake)
    need = seen.select("environment").distinct().withColumn("language", F.explode(F.array(*map(F.lit, REQUIRED_LANGUAGES))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return need.join(seen, ["environment", "language"], "full").select("environment", "language", language_name(F.col("language")).alias("language_name"), zero("total_queries"), zero("grounded_rate"), zero("avg_total_latency_ms"), F.coalesce("status", F.lit("No Data")).alias("status"))


def language_distribution(lake: DataFrame) -> DataFrame:
    """AG12."""
    out = per_environment(queries(lake), ("language",), F.count("*").alias("count"), mean("total_latency_ms").alias("a"), _n("fallback_used").alias("fallback_count"))
    return out.select("environment", "language", "count", _share("count").alias("percentage"), rounded(F.coalesce("a", F.lit(0.0)), 1).alias("avg_latency_ms"), "fallback_count", percent(F.col("fallback_count"), F.col("count"), 1).alias("fallback_rate"))


def script_distribution(lake: DataFrame) -> DataFrame:
    """AG13."""
    return per_environment(queries(lake), ("script",), F.count("*").alias("queries"))


def with_previous_language(lake: DataFrame) -> DataFrame:
    """WN1: the language of the session's query before, in order of time and event."""
    session = Window.partitionBy("session_id").orderBy("timestamp", "event_id")
    return queries(lake).withColumn("lag_language", F.lag("language").over(session))


def _transitions(switched: DataFrame, before: str) -> DataFrame:
    return per_environment(switched.withColumn("from_language", F.col(before)).withColumn("to_language", F.col("language")), ("from_language", "to_language"), F.count("*").alias("transition_count"))


def explicit_transitions(lake: DataFrame) -> DataFrame:
    """AG14: by the language that the event itself names as the one before."""
    named = F.coalesce("previous_language", F.lit(""))
    return _transitions(queries(lake).filter((named != "") & (named != F.col("language"))), "previous_language")


def derived_transitions(lake: DataFrame) -> DataFrame:
    """AG15: by the order of queries in a session."""
    return _transitions(with_previous_language(lake).filter("lag_language IS NOT NULL AND lag_language <> language"), "lag_language")


def transitions(lake: DataFrame) -> DataFrame:
    """The explicit transitions where any event has one, else the derived ones."""
    explicit = explicit_transitions(lake)
    any_named = F.broadcast(explicit.select(F.lit(1).alias("one")).limit(1))  # one row or none
    derived = derived_transitions(lake).join(any_named, F.col("one") == 1, "left_anti")
    return explicit.unionByName(derived)


def transition_matrix(moves: DataFrame) -> DataFrame:
    """AG16: a row for each language left, a column for each of the required languages, and their share of all switches."""
    cell = lambda to: F.coalesce(F.sum(F.when(F.col("to_language") == to, F.col("transition_count"))), F.lit(0)).alias(f"to_{to}")
    out = moves.groupBy("environment", "from_language").agg(*map(cell, REQUIRED_LANGUAGES), F.sum("transition_count").alias("switches"))
    return out.withColumn("share_pct", _share("switches"))


def script_comparison(lake: DataFrame) -> DataFrame:
    """AG17: code-mixed and romanised queries overlap; native ones are neither. One pass over rows repeated per category."""
    names = F.array_compact(F.array(F.when(~F.col("is_code_mixed") & ~F.col("is_romanized"), "Native Script Standard"), F.when(F.col("is_code_mixed"), "Code-Mixed"), F.when(F.col("is_romanized"), "Romanized Indic")))
    rows = queries(lake).withColumn("category", F.explode(names))
    out = per_environment(rows, ("category",), F.count("*").alias("query_count"), _n("grounded").alias("g"), _n("fallback_used").alias("f"), mean("total_latency_ms").alias("a"), mean("retrieval_latency_ms").alias("r"), mean("retrieved_chunk_count").alias("k"))
    totals = per_environment(queries(lake), (), F.count("*").alias("t"))
    rate = lambda c: percent(F.col(c), F.col("query_count"), 1)
    value = lambda c, d: rounded(F.coalesce(c, F.lit(0.0)), d)
    return out.join(F.broadcast(totals), "environment").select(
        "environment", "category", "query_count", percent(F.col("query_count"), F.col("t"), 1).alias("share_pct"), rate("g").alias("grounded_rate"), rate("f").alias("fallback_rate"),
        value("a", 1).alias("avg_latency_ms"), value("r", 2).alias("avg_retrieval_latency_ms"), value("k", 2).alias("avg_retrieved_chunks"),
    )


def latency_percentiles(lake: DataFrame) -> DataFrame:
    """AG33: interpolated, of retrieval and of whole answers to queries."""
    names = {f"{c}_p{q}_ms": (f"{c}_latency_ms", q / 100) for c in ("retrieval", "total") for q in (50, 95)}
    out = with_percentiles(per_environment(queries(lake), (), F.count("*").alias("n")), _everywhere(queries(lake)), ("environment",), names, interpolated=True)
    return out.select("environment", *[F.coalesce(rounded(F.col(c), 2), F.lit(0.0)).alias(c) for c in names])


def document_usage(lake: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """AG18, JN1: how each document was used; its share is of all queries. ``titles``: document_id, title; a document without one is named by its id."""
    used = queries(lake).filter(F.coalesce("document_id", F.lit("")) != "")
    out = per_environment(
        used, ("document_id",), F.count("*").alias("query_count"), F.greatest(F.countDistinct("anonymous_user_id"), F.lit(1)).alias("unique_users"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages_used"), _n("grounded").alias("g"), _n("fallback_used").alias("f"), mean("total_latency_ms").alias("a"), mean("citation_count").alias("c"),
    )
    totals = per_environment(queries(lake), (), F.count("*").alias("t"))
    rate = lambda c: percent(F.col(c), F.col("query_count"), 1)
    value = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 1)
    title = F.concat(F.lit("Institutional Document ("), "document_id", F.lit(")"))
    if titles is not None:
        out, title = out.join(titles.select("document_id", F.col("title").alias("known_title")), "document_id", "left"), F.coalesce(F.when(F.trim("known_title") != "", F.col("known_title")), title)
    return out.join(F.broadcast(totals), "environment").select(
        "environment", "document_id", title.alias("title"), "query_count", percent(F.col("query_count"), F.col("t"), 1).alias("query_share_pct"), "unique_users", "languages_used",
        rate("g").alias("grounded_rate"), rate("f").alias("fallback_rate"), value("a").alias("avg_latency_ms"), value("c").alias("avg_citations"),
    )


def retrieval(lake: DataFrame) -> DataFrame:
    """AG19: over all events, errors too."""
    out = per_environment(
        lake, (), mean("retrieval_latency_ms").alias("a"), mean("candidate_count").alias("c"),
        mean("retrieved_chunk_count").alias("k"), mean("variant_count").alias("v"), mean("reranking_latency_ms").alias("r"), mean("best_retrieval_score").alias("b"),
    )
    out = with_percentiles(out, _everywhere(lake), ("environment",), {"p50": ("retrieval_latency_ms", 0.5), "p95": ("retrieval_latency_ms", 0.95)})
    value = lambda c, d=2, none=0.0: rounded(F.coalesce(c, F.lit(none)), d)
    return out.select(
        "environment", value("a").alias("avg_retrieval_latency_ms"), value("p50").alias("p50_retrieval_latency_ms"), value("p95").alias("p95_retrieval_latency_ms"), value("c").alias("avg_candidate_count"),
        value("k").alias("avg_retrieved_chunk_count"), value("v", 2, 1.0).alias("avg_query_variant_count"), value("r").alias("avg_reranking_latency_ms"), value("b", 4).alias("avg_best_retrieval_score"),
    )


def retrieval_by_language(lake: DataFrame) -> DataFrame:
    """AG20."""
    out = per_environment(lake, ("language",), mean("retrieval_latency_ms").alias("a"), mean("candidate_count").alias("c"), mean("variant_count").alias("v"))
    value = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 2)
    return out.select("environment", "language", value("a").alias("avg_latency_ms"), value("c").alias("avg_candidates"), value("v").alias("avg_variants"))


def answers(lake: DataFrame) -> DataFrame:
    """AG21: over queries only."""
    out = per_environment(
        queries(lake), (), F.count("*").alias("queries_evaluated"), mean("total_latency_ms").alias("a"),
        mean("generation_latency_ms").alias("w"), mean("citation_count").alias("n"), _n("grounded").alias("g"), _n("citation_valid").alias("c"), _n("fallback_used").alias("f"),
    )
    out = with_percentiles(out, _everywhere(queries(lake)), ("environment",), {"p50": ("total_latency_ms", 0.5), "p95": ("total_latency_ms", 0.95)})
    value = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 2)
    rate = lambda c: percent(F.col(c), F.col("queries_evaluated"), 2)
    return out.select(
        "environment", "queries_evaluated", value("a").alias("avg_total_latency_ms"), value("p50").alias("p50_total_latency_ms"), value("p95").alias("p95_total_latency_ms"), value("w").alias("avg_generation_latency_ms"),
        rate("g").alias("grounded_answer_rate"), rate("c").alias("citation_validity_rate"), rate("f").alias("fallback_answer_rate"), value("n").alias("avg_citation_count"),
    )


def reliability(lake: DataFrame) -> DataFrame:
    """AG23: errors of all events, fallbacks of queries."""
    query = F.col("event_type").isin(*QUERY_TYPES)
    out = per_environment(lake, (), F.count("*").alias("total_records"), _n(F.col("error") | (F.col("event_type") == "error")).alias("error_events_count"), _n(query & F.col("fallback_used")).alias("fallback_events_count"), _n(query).alias("q"))
    return out.select("environment", "total_records", "error_events_count", percent(F.col("error_events_count"), F.col("total_records"), 2).alias("overall_error_rate"), "fallback_events_count", percent(F.col("fallback_events_count"), F.col("q"), 2).alias("fallback_rate"))


def errors_by_type(lake: DataFrame) -> DataFrame:
    return per_environment(errors(lake).filter(F.coalesce("error_type", F.lit("")) != ""), ("error_type",), F.count("*").alias("errors"))


def daily_trends(lake: DataFrame) -> DataFrame:
    """AG24."""
    out = per_environment(queries(lake), ("date",), F.count("*").alias("queries"), F.greatest(F.countDistinct("anonymous_user_id"), F.lit(1)).alias("active_users"), mean("total_latency_ms").alias("a"), _n("fallback_used").alias("fallback_count"), _n("grounded").alias("grounded_count"))
    rate = lambda c: percent(F.col(c), F.col("queries"), 2)
    return out.select("environment", "date", "queries", "active_users", rounded(F.coalesce("a", F.lit(0.0)), 2).alias("avg_latency_ms"), rate("fallback_count").alias("fallback_rate"), rate("grounded_count").alias("grounded_rate"), "grounded_count", "fallback_count")


def summary(lake: DataFrame) -> DataFrame:
    """AG25: one row an environment: one aggregation of all that counts rows, one of languages, one of percentiles."""
    asked = F.coalesce(F.col("event_type").isin(*QUERY_TYPES), F.lit(False))
    of = lambda c: F.when(asked, F.col(c))
    out = per_environment(
        lake, (), F.count("*").alias("source_record_count"), _n(F.col("event_type") == "retrieval_completed").alias("total_retrieval_events"), _n(asked).alias("n"),
        F.countDistinct(F.when(F.col("anonymous_user_id") != "", of("anonymous_user_id"))).alias("u"), mean(of("total_latency_ms")).alias("a"), mean("retrieval_latency_ms").alias("r"),
        _n(of("grounded")).alias("g"), _n(of("citation_valid")).alias("c"), _n(of("fallback_used")).alias("f"), _n(of("is_code_mixed")).alias("mixed"), _n(F.col("error") | (F.col("event_type") == "error")).alias("e"),
    )
    out = with_percentiles(out, _everywhere(lake.withColumn("asked_ms", of("total_latency_ms"))), ("environment",), {"p": ("asked_ms", 0.95), "q": ("retrieval_latency_ms", 0.95)})
    languages = per_environment(queries(lake), ("language",), F.count("*").alias("n")).groupBy("environment").agg(F.min(F.struct(-F.col("n"), "language"))["language"].alias("most"), F.count("*").alias("languages_active"))
    some = lambda c: F.when(F.col("n") > 0, c)
    rate = lambda c: some(percent(F.col(c), F.col("n"), 2))
    value = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 2)
    return out.join(languages, "environment", "left").select(
        "environment", "source_record_count", some(F.col("n")).alias("total_queries"), some(F.col("u")).alias("total_unique_users"), some(F.when(F.col("u") > 0, rounded(F.col("n") / F.col("u"), 2)).otherwise(0.0)).alias("avg_queries_per_user"),
        F.coalesce("most", F.lit("en")).alias("most_used_language"), "languages_active", "total_retrieval_events", rate("g").alias("grounded_answer_rate"), rate("c").alias("citation_validity_rate"), rate("f").alias("fallback_answer_rate"),
        percent(F.col("e"), F.col("source_record_count"), 2).alias("error_rate"), value("r").alias("avg_retrieval_latency_ms"), value("q").alias("p95_retrieval_latency_ms"), some(value("a")).alias("avg_total_latency_ms"), some(value("p")).alias("p95_total_latency_ms"),
        percent(F.col("mixed"), F.col("n"), 1).alias("code_mixed_query_share"),
    )


#: JB3: the metric family, a table each.
FAMILY = {
    "volume_by_type": lambda lake: volume(lake, "event_type"), "volume_by_date": lambda lake: volume(lake, "date"), "volume_by_hour": lambda lake: volume(lake, "hour"),
    "headline": headline, "users": top_users, "user_profiles": user_profiles, "daily_active": daily_active, "language_performance": language_performance, "language_distribution": language_distribution,
    "scripts": script_distribution, "transitions": transitions, "script_comparison": script_comparison, "documents": document_usage, "retrieval": retrieval, "answers": answers, "reliability": reliability, "daily_trends": daily_trends, "summary": summary,
}
