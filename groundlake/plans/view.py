"""The ``events`` table seen as a lake of question-answering events: expressions that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> expression over events and k, the number in props. The same text runs on either engine.
EXPRESSIONS = {
    "event_id": "CAST(event_id AS STRING)",
    "event_type": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'retrieval_completed' WHEN 'click' THEN 'rag_response' ELSE 'query_completed' END",
    "telemetry_environment": "CASE user_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'test' ELSE 'fixture' END",
    "timestamp": "ts",
    "date": "CAST(CAST(ts AS DATE) AS STRING)",
    "hour": "CAST(EXTRACT(HOUR FROM ts) AS INT)",
    "anonymous_user_id": "CASE WHEN user_id % 17 = 0 THEN '' ELSE concat('USER-', CAST(user_id AS STRING)) END",
    "session_id": "concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING))",
    "document_id": "CASE WHEN k % 13 = 0 THEN '' ELSE concat('DOC-', CAST(k % 12 AS STRING)) END",
    "language": "CASE WHEN k % 10 < 4 THEN 'en' WHEN k % 10 < 6 THEN 'hi' WHEN k % 10 < 8 THEN 'kn' WHEN k % 10 = 8 THEN 'te' ELSE 'und' END",
    "previous_language": "CASE WHEN k % 7 = 0 THEN 'en' WHEN k % 7 = 1 THEN 'hi' ELSE '' END",
    "script": "CASE WHEN k % 10 < 4 THEN 'latin' WHEN k % 10 < 6 THEN 'devanagari' WHEN k % 10 < 8 THEN 'kannada' WHEN k % 10 = 8 THEN 'telugu' ELSE 'unknown' END",
    "is_code_mixed": "k % 8 = 0",
    "is_romanized": "k % 9 = 0",
    "variant_count": "CAST(1 + k % 3 AS INT)",
    "candidate_count": "CAST(k % 21 AS INT)",
    "retrieved_chunk_count": "CAST(k % 6 AS INT)",
    "selected_chunk_count": "CAST(k % 5 AS INT)",
    "best_retrieval_score": "CAST(k AS DOUBLE) / 128",
    "retrieval_latency_ms": "value",
    "reranking_latency_ms": "value / 16",
    "generation_latency_ms": "value * 8",
    "total_latency_ms": "value * 10",
    "provider": "CASE k % 4 WHEN 0 THEN 'gemini' WHEN 1 THEN 'groq' WHEN 2 THEN 'ollama' ELSE 'mock' END",
    "fallback_used": "k % 6 = 0",
    "citation_count": "CAST(k % 4 AS INT)",
    "citation_valid": "k % 6 <> 0 AND k % 25 <> 1",
    "grounded": "k % 6 <> 0",
    "error": "event_type = 'error'",
    "error_type": "CASE WHEN event_type <> 'error' THEN '' WHEN k % 3 = 0 THEN 'timeout' WHEN k % 3 = 1 THEN 'provider' ELSE '' END",
}


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    keyed = events.selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return keyed.selectExpr(*[f"{e} AS {n}" for n, e in EXPRESSIONS.items()])


LAKE_SQL = "lake AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in EXPRESSIONS.items()) + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"
