"""Sources and sinks of events, metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column types of the lake; what an empty or partial one is read with.
LAKE = (
    "schema_version string, event_id string, event_type string, telemetry_environment string, timestamp string, date string, hour int, request_id_hash string, anonymous_user_id string, user_identity_available boolean, session_id string, "
    "document_id string, query_id string, retrieval_id string, language string, previous_language string, script string, query_type string, is_code_mixed boolean, is_romanized boolean, variant_count int, candidate_count int, "
    "retrieved_chunk_count int, selected_chunk_count int, best_retrieval_score double, latency_ms double, retrieval_latency_ms double, reranking_latency_ms double, generation_latency_ms double, total_latency_ms double, provider string, "
    "answer_mode string, fallback_used boolean, fallback_reason string, citation_count int, citation_valid boolean, grounded boolean, error boolean, error_type string"
)
PARTITIONS = ("telemetry_environment", "date", "event_type")


def read_events_jsonl(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """SRC1: (source_file, line_number, line) of all ``names`` under ``path``; blank lines are skipped but counted.

    A split of a file numbers its own lines; only a count a split is put in order, so that no task holds a whole file.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.option("pathGlobFilter", names).text(path).select("value", F.col("_metadata.file_name").alias("source_file"), *place, F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.join(splits.select("file", "block", (before + 1 - F.col("first")).alias("shift")), ["file", "block"])
    return numbered.select("source_file", (F.col("at") + F.col("shift")).alias("line_number"), F.col("value").alias("line")).filter("trim(line) <> ''")


def write_by_type(events: DataFrame, path: str, mode: str = "append") -> None:
    """SNK1, SNK2: JSON lines by event type."""
    events.write.mode(mode).partitionBy("event_type").json(path)


def write_rejected(rejected: DataFrame, path: str, mode: str = "append") -> None:
    """SNK3: without payload, dated."""
    rejected.withColumn("rejected_at", F.current_timestamp()).write.mode(mode).json(path)


def write_lake(lake: DataFrame, path: str, whole: bool = True) -> None:
    """SNK4: Snappy Parquet by environment, date and type. A run replaces the lake; if not ``whole``, only the partitions it has rows for."""
    lake.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").option("compression", "snappy").partitionBy(*PARTITIONS).parquet(path)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: with declared types, so that dates stay text and partition filters prune."""
    return spark.read.schema(LAKE).parquet(path)


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    """SNK5: a table for each metric, by environment, and the run's manifest (name, environment, rows, schema_version, generated_at) as JSON."""
    counts = []
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("environment").parquet(f"{path}/{name}")
        counts.append(table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}").groupBy("environment").agg(F.count("*").alias("rows")).withColumn("name", F.lit(name)))
    manifest = reduce(DataFrame.unionByName, counts).withColumns({"schema_version": F.lit("1.0"), "generated_at": F.current_timestamp()})
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_metrics_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, environment string, rows long, schema_version string, generated_at timestamp").json(f"{path}/manifest")


def write_report(report: DataFrame, path: str) -> None:
    """SNK6: a few rows of aggregates as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
