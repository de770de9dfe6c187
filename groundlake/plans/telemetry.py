"""Registered queries over the event lake, each with SQL of its own."""

from __future__ import annotations

from ..operators import metrics as m
from .view import LAKE_SQL, lake

ENV = "COALESCE(telemetry_environment, 'all') AS environment"
QUERY = "event_type IN ('query_completed', 'rag_response')"
REQUIRED = "(VALUES ('en'), ('hi'), ('kn'), ('te')) AS need(language)"


def rnd(e: str, d: int) -> str:
    return f"floor(({e}) * {10**d} + 0.5) / {10**d}"


def mean(c: str) -> str:
    return f"(CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / count({c}))"


def avg(c: str, d: int) -> str:
    return rnd(f"COALESCE({mean(c)}, CAST(0 AS DOUBLE))", d)


def pct(part: str, whole: str, d: int = 1) -> str:
    return rnd(f"CAST({part} AS DOUBLE) * 100 / greatest({whole}, 1)", d)


def rate(flag: str, d: int = 1) -> str:
    return pct(f"count(*) FILTER (WHERE {flag})", "count(*)", d)


def share(count: str = "count(*)") -> str:
    return pct(count, f"sum({count}) OVER (PARTITION BY COALESCE(telemetry_environment, 'all'))", 1)


def sets(*keys: str) -> str:
    return f"GROUPING SETS ((telemetry_environment{''.join(', ' + k for k in keys)}), ({', '.join(keys)}))"


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([LAKE_SQL, f'q AS (SELECT * FROM lake WHERE {QUERY})', *ctes])} {body}"


def grouped(columns: str, table: str, *keys: str) -> str:
    names = "".join(f", {k}" for k in keys)
    return f"SELECT {ENV}{names}, {columns} FROM {table} GROUP BY {sets(*keys)}"


NAME = "CASE language WHEN 'en' THEN 'English' WHEN 'hi' THEN 'हिन्दी (Hindi)' WHEN 'kn' THEN 'ಕನ್ನಡ (Kannada)' WHEN 'te' THEN 'తెలుగు (Telugu)' ELSE upper(language) END"
STATUS = f"CASE WHEN {rate('grounded')} >= 80 THEN 'Excellent' WHEN {rate('grounded')} >= 60 THEN 'Good' ELSE 'Needs Attention' END"
USER = "(SELECT * FROM q WHERE anonymous_user_id <> '')"
LANGS = "array_to_string(list_sort(list(DISTINCT language)), ',')"

LANGUAGES = grouped(
    f"{NAME} AS language_name, count(*) AS total_queries, {share()} AS query_share_pct, {rate('grounded')} AS grounded_rate, {rate('citation_valid')} AS citation_validity_rate, {rate('fallback_used')} AS fallback_rate, "
    f"{avg('total_latency_ms', 1)} AS avg_total_latency_ms, {rnd('quantile_disc(total_latency_ms, 0.95)', 1)} AS p95_total_latency_ms, {avg('retrieval_latency_ms', 2)} AS avg_retrieval_latency_ms, "
    f"{avg('generation_latency_ms', 1)} AS avg_generation_latency_ms, {avg('retrieved_chunk_count', 2)} AS avg_retrieved_chunks, {avg('citation_count', 2)} AS avg_citations, count(*) FILTER (WHERE is_code_mixed) AS code_mixed_count, "
    f"{rate('is_code_mixed')} AS code_mixed_rate, count(*) FILTER (WHERE is_romanized) AS romanized_count, {STATUS} AS status",
    "q", "language",
)
USERS = grouped(
    f"count(*) AS query_count, {LANGS} AS languages_used, count(DISTINCT document_id) FILTER (WHERE trim(document_id) <> '') AS documents_accessed, {rate('grounded')} AS grounded_rate, {rate('fallback_used')} AS fallback_rate, {avg('total_latency_ms', 1)} AS avg_latency_ms",
    USER, "anonymous_user_id",
)
PROFILE = "CASE WHEN mixed >= 0.4 THEN 'Code-Mixed & Romanized' WHEN langs = 'en' THEN 'English Only' WHEN langs IN ('en,hi', 'hi') THEN 'English + Hindi' WHEN langs IN ('en,kn', 'kn') THEN 'English + Kannada' WHEN langs IN ('en,te', 'te') THEN 'English + Telugu' ELSE 'Multilingual (3+ Languages)' END"
PROFILES = ", ".join(f"('{p}')" for p in m.PROFILES)
USER_SUMMARY = f"SELECT {ENV}, count(*) AS total_queries, count(DISTINCT CASE WHEN anonymous_user_id <> '' THEN anonymous_user_id END) AS total_unique_users, CASE WHEN count(DISTINCT CASE WHEN anonymous_user_id <> '' THEN anonymous_user_id END) > 0 THEN {rnd(chr(67) + 'AST(count(*) AS DOUBLE) / count(DISTINCT CASE WHEN anonymous_user_id <> ' + chr(39) * 2 + ' THEN anonymous_user_id END)', 2)} ELSE 0 END AS avg_queries_per_user FROM q GROUP BY {sets()}"
LAGGED = "lagged AS (SELECT *, lag(language) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS lag_language FROM q)"
EXPLICIT = f"SELECT {ENV}, previous_language AS from_language, language AS to_language, count(*) AS transition_count FROM q WHERE previous_language <> '' AND previous_language <> language GROUP BY {sets('previous_language', 'language')}"
DERIVED = f"SELECT {ENV}, lag_language AS from_language, language AS to_language, count(*) AS transition_count FROM lagged WHERE lag_language IS NOT NULL AND lag_language <> language GROUP BY {sets('lag_language', 'language')}"
TOTALS = f"totals AS (SELECT {ENV}, count(*) AS t FROM q GROUP BY {sets()})"
CATEGORIES = (
    "cat AS (SELECT *, 'Native Script Standard' AS category FROM q WHERE NOT is_code_mixed AND NOT is_romanized UNION ALL SELECT *, 'Code-Mixed' FROM q WHERE is_code_mixed UNION ALL SELECT *, 'Romanized Indic' FROM q WHERE is_romanized)"
)
COMPARE = (
    f"SELECT environment, category, query_count, {pct('query_count', 't')} AS share_pct, grounded_rate, fallback_rate, avg_latency_ms, avg_retrieval_latency_ms, avg_retrieved_chunks FROM ("
    + grouped(f"count(*) AS query_count, {rate('grounded')} AS grounded_rate, {rate('fallback_used')} AS fallback_rate, {avg('total_latency_ms', 1)} AS avg_latency_ms, {avg('retrieval_latency_ms', 2)} AS avg_retrieval_latency_ms, {avg('retrieved_chunk_count', 2)} AS avg_retrieved_chunks", "cat", "category")
    + ") JOIN totals USING (environment)"
)
RETRIEVAL = (
    f"SELECT {ENV}, {avg('retrieval_latency_ms', 2)} AS avg_retrieval_latency_ms, {rnd('quantile_disc(retrieval_latency_ms, 0.5)', 2)} AS p50_retrieval_latency_ms, {rnd('quantile_disc(retrieval_latency_ms, 0.95)', 2)} AS p95_retrieval_latency_ms, "
    f"{avg('candidate_count', 2)} AS avg_candidate_count, {avg('retrieved_chunk_count', 2)} AS avg_retrieved_chunk_count, {avg('variant_count', 2)} AS avg_query_variant_count, {avg('reranking_latency_ms', 2)} AS avg_reranking_latency_ms, "
    f"{avg('best_retrieval_score', 4)} AS avg_best_retrieval_score FROM lake GROUP BY {sets()}"
)
ANSWERS = (
    f"SELECT {ENV}, count(*) AS queries_evaluated, {avg('total_latency_ms', 2)} AS avg_total_latency_ms, {rnd('quantile_disc(total_latency_ms, 0.5)', 2)} AS p50_total_latency_ms, {rnd('quantile_disc(total_latency_ms, 0.95)', 2)} AS p95_total_latency_ms, "
    f"{avg('generation_latency_ms', 2)} AS avg_generation_latency_ms, {rate('grounded', 2)} AS grounded_answer_rate, {rate('citation_valid', 2)} AS citation_validity_rate, {rate('fallback_used', 2)} AS fallback_answer_rate, {avg('citation_count', 2)} AS avg_citation_count FROM q GROUP BY {sets()}"
)
ERRORS = "count(*) FILTER (WHERE error OR event_type = 'error')"
FELL = f"count(*) FILTER (WHERE {QUERY} AND fallback_used)"
RELIABLE = f"SELECT {ENV}, count(*) AS total_records, {ERRORS} AS error_events_count, {pct(ERRORS, 'count(*)', 2)} AS overall_error_rate, {FELL} AS fallback_events_count, {pct(FELL, f'count(*) FILTER (WHERE {QUERY})', 2)} AS fallback_rate FROM lake GROUP BY {sets()}"
HEADLINE = f"SELECT {ENV}, count(*) AS total_records, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_count" for t in ("query_completed", "retrieval_completed", "rag_response", "error")) + f" FROM lake GROUP BY {sets()}"
MATRIX = ", ".join(f"CAST(COALESCE(sum(transition_count) FILTER (WHERE to_language = '{x}'), 0) AS BIGINT) AS to_{x}" for x in m.REQUIRED_LANGUAGES)
SWITCH_SHARE = pct("switches", "sum(switches) OVER (PARTITION BY environment)", 1)


def on(f):
    return lambda spark, sf_dir: f(lake(spark, sf_dir))


#: key -> (query, SQL)
QUERIES = {
    "ag01_environment_rollout": (on(lambda t: m.per_environment(t, (), m.F.count("*").alias("events"))), sql(f"SELECT {ENV}, count(*) AS events FROM lake GROUP BY {sets()}")),
    "ag02_volume_by_type": (on(lambda t: m.volume(t, "event_type")), sql(grouped("count(*) AS events", "lake", "event_type"))),
    "ag03_volume_by_date": (on(lambda t: m.volume(t, "date")), sql(grouped("count(*) AS events", "lake", "date"))),
    "ag04_volume_by_hour": (on(lambda t: m.volume(t, "hour")), sql(grouped("count(*) AS events", "lake", "hour"))),
    "ag05_headline_counts": (on(m.headline), sql(HEADLINE)),
    "ag06_users": (on(m.users), sql(USERS)),
    "ag07_user_profiles": (
        on(m.user_profiles),
        sql(
            f"SELECT environment, profile, user_count, {pct('user_count', 'sum(user_count) OVER (PARTITION BY environment)')} AS percentage FROM (SELECT e.environment, p.profile, COALESCE(n, 0) AS user_count FROM (SELECT DISTINCT environment FROM counts) e CROSS JOIN (VALUES {PROFILES}) AS p(profile) LEFT JOIN counts c ON c.environment = e.environment AND c.profile = p.profile)",
            "each AS (" + grouped(f"{LANGS} AS langs, CAST(count(*) FILTER (WHERE is_code_mixed) AS DOUBLE) / count(*) AS mixed", USER, "anonymous_user_id") + ")",
            f"counts AS (SELECT environment, {PROFILE} AS profile, count(*) AS n FROM each GROUP BY ALL)",
        ),
    ),
    "ag08_daily_active": (on(m.daily_active), sql(grouped("greatest(count(DISTINCT anonymous_user_id), 1) AS active_users, count(*) AS queries", "q", "date"))),
    "ag09_language_performance": (on(m.language_performance), sql(LANGUAGES)),
    "ag10_providers_by_language": (on(lambda t: m.providers(t, "language")), sql(grouped("count(*) AS events", "q", "language", "provider"))),
    "ag11_padded_languages": (
        on(m.padded_languages),
        sql(
            f"SELECT COALESCE(n.environment, s.environment) AS environment, COALESCE(n.language, s.language) AS language, {NAME.replace('language ', 'COALESCE(n.language, s.language) ', 1).replace('upper(language)', 'upper(COALESCE(n.language, s.language))')} AS language_name, COALESCE(total_queries, 0) AS total_queries, COALESCE(grounded_rate, 0) AS grounded_rate, COALESCE(avg_total_latency_ms, 0) AS avg_total_latency_ms, COALESCE(status, 'No Data') AS status "
            f"FROM (SELECT environment, language FROM (SELECT DISTINCT environment FROM seen) CROSS JOIN {REQUIRED}) n FULL JOIN seen s ON n.environment = s.environment AND n.language = s.language",
            f"seen AS ({LANGUAGES})",
        ),
    ),
    "ag12_language_distribution": (on(m.language_distribution), sql(grouped(f"count(*) AS count, {share()} AS percentage, {avg('total_latency_ms', 1)} AS avg_latency_ms, count(*) FILTER (WHERE fallback_used) AS fallback_count, {rate('fallback_used')} AS fallback_rate", "q", "language"))),
    "ag13_script_distribution": (on(m.script_distribution), sql(grouped("count(*) AS queries", "q", "script"))),
    "ag14_explicit_transitions": (on(m.explicit_transitions), sql(EXPLICIT)),
    "ag15_derived_transitions": (on(m.derived_transitions), sql(DERIVED, LAGGED)),
    "ag16_transition_matrix": (on(lambda t: m.transition_matrix(m.derived_transitions(t))), sql(f"SELECT environment, from_language, {', '.join('to_' + x for x in m.REQUIRED_LANGUAGES)}, switches, {SWITCH_SHARE} AS share_pct FROM (SELECT environment, from_language, {MATRIX}, CAST(sum(transition_count) AS BIGINT) AS switches FROM ({DERIVED}) GROUP BY ALL)", LAGGED)),
    "ag16_transitions_chosen": (on(lambda t: m.transitions(t.withColumn("previous_language", m.F.lit("")))), sql(DERIVED, LAGGED)),
    "ag17_script_comparison": (on(m.script_comparison), sql(COMPARE, CATEGORIES, TOTALS)),
    "ag18_document_usage": (
        on(m.document_usage),
        sql(
            f"SELECT environment, document_id, title, query_count, {pct('query_count', 't')} AS query_share_pct, unique_users, languages_used, grounded_rate, fallback_rate, avg_latency_ms, avg_citations FROM ("
            + grouped(f"concat('Institutional Document (', document_id, ')') AS title, count(*) AS query_count, greatest(count(DISTINCT anonymous_user_id), 1) AS unique_users, {LANGS} AS languages_used, {rate('grounded')} AS grounded_rate, {rate('fallback_used')} AS fallback_rate, {avg('total_latency_ms', 1)} AS avg_latency_ms, {avg('citation_count', 1)} AS avg_citations", "(SELECT * FROM q WHERE document_id <> '')", "document_id")
            + ") JOIN totals USING (environment)",
            TOTALS,
        ),
    ),
    "ag19_retrieval": (on(m.retrieval), sql(RETRIEVAL)),
    "ag20_retrieval_by_language": (on(m.retrieval_by_language), sql(grouped(f"{avg('retrieval_latency_ms', 2)} AS avg_latency_ms, {avg('candidate_count', 2)} AS avg_candidates, {avg('variant_count', 2)} AS avg_variants", "lake", "language"))),
    "ag21_answers": (on(m.answers), sql(ANSWERS)),
    "ag22_providers": (on(m.providers), sql(grouped("count(*) AS events", "q", "provider"))),
    "ag23_reliability": (on(m.reliability), sql(RELIABLE)),
    "ag23_errors_by_type": (on(m.errors_by_type), sql(grouped("count(*) AS errors", "(SELECT * FROM lake WHERE (error OR event_type = 'error') AND error_type <> '')", "error_type"))),
    "ag24_daily_trends": (on(m.daily_trends), sql(grouped(f"count(*) AS queries, greatest(count(DISTINCT anonymous_user_id), 1) AS active_users, {avg('total_latency_ms', 2)} AS avg_latency_ms, {rate('fallback_used', 2)} AS fallback_rate, {rate('grounded', 2)} AS grounded_rate, count(*) FILTER (WHERE grounded) AS grounded_count, count(*) FILTER (WHERE fallback_used) AS fallback_count", "q", "date"))),
    "ag25_summary": (
        on(m.summary),
        sql(
            "SELECT h.environment, total_records AS source_record_count, total_queries, total_unique_users, avg_queries_per_user, COALESCE(most_used_language, 'en') AS most_used_language, languages_active, retrieval_completed_count AS total_retrieval_events, grounded_answer_rate, citation_validity_rate, fallback_answer_rate, overall_error_rate AS error_rate, avg_retrieval_latency_ms, p95_retrieval_latency_ms, avg_total_latency_ms, p95_total_latency_ms, COALESCE(share_pct, 0) AS code_mixed_query_share "
            "FROM h LEFT JOIN u USING (environment) LEFT JOIN l USING (environment) LEFT JOIN a USING (environment) LEFT JOIN (SELECT environment, overall_error_rate FROM e) USING (environment) LEFT JOIN r USING (environment) LEFT JOIN (SELECT environment, share_pct FROM c WHERE category = 'Code-Mixed') USING (environment)",
            CATEGORIES, TOTALS, f"h AS ({HEADLINE})", f"u AS ({USER_SUMMARY})", f"a AS ({ANSWERS})", f"e AS ({RELIABLE})", f"r AS ({RETRIEVAL})", f"c AS ({COMPARE})", f"langs AS ({LANGUAGES})",
            "l AS (SELECT environment, arg_min(language, rank) AS most_used_language, count(*) AS languages_active FROM (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY total_queries DESC, language) AS rank FROM langs) GROUP BY environment)",
        ),
    ),
    "wn01_previous_language": (on(lambda t: m.with_previous_language(t).select("event_id", "session_id", "language", "lag_language")), sql("SELECT event_id, session_id, language, lag_language FROM lagged", LAGGED)),
    "so01_top_users": (on(m.top_users), sql(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY environment ORDER BY query_count DESC, anonymous_user_id) AS INT) AS rank FROM ({USERS})) WHERE rank <= 25")),
    "user_summary": (on(m.user_summary), sql(USER_SUMMARY)),
    "prj05_query_events": (on(lambda t: m.queries(t).select("event_id", "event_type")), sql("SELECT event_id, event_type FROM q")),
    "prj06_identified": (on(lambda t: m.identified(t).select("event_id", "anonymous_user_id")), sql("SELECT event_id, anonymous_user_id FROM lake WHERE anonymous_user_id <> ''")),
    "prj07_live_slice": (on(lambda t: t.filter("telemetry_environment = 'live'").select("event_id", "telemetry_environment")), sql("SELECT event_id, telemetry_environment FROM lake WHERE telemetry_environment = 'live'")),
    "prj08_error_events": (on(lambda t: m.errors(t).select("event_id", "error_type")), sql("SELECT event_id, error_type FROM lake WHERE error OR event_type = 'error'")),
    "so02_documents_by_use": (on(lambda t: t.filter("document_id <> ''").groupBy("document_id").agg(m.F.count("*").alias("uses")).orderBy(m.F.desc("uses"), "document_id")), sql("SELECT document_id, count(*) AS uses FROM lake WHERE document_id <> '' GROUP BY document_id ORDER BY uses DESC, document_id")),
}
