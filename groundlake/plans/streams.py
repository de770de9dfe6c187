"""Registered queries of streams: the events arrive in three lots, each met by a new run of one checkpoint; what was written is read back."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as e
from ..operators import metrics as m
from ..sources.shared import shared_folder
from ..streaming import events as st
from .ingest import CHECKED, LINES_SQL, lines
from .view import LAKE_SQL, lake

LOTS = 3
FILE_ROWS = 20_000  # most rows of an arriving file: a row may be a few bytes there and much work for its batch, which is dealt by files
#: Lots by day of the month; every fiftieth event comes with the last one, whenever it was.
LOT = "CASE WHEN CAST(event_id AS BIGINT) % 50 = 0 THEN 2 ELSE least(2, CAST(floor((EXTRACT(DAY FROM timestamp) - 1) / 11) AS INT)) END"
#: Lots by hour, so that a session goes on in later ones.
HOURS = "CAST(floor(hour / 8) AS INT)"


def arriving(rows: DataFrame, name: str, start: Callable[[DataFrame, str], object]) -> str:
    """Write the rows of each ``lot`` to a folder and run ``start(stream, folder)`` to its end, once a lot; the folder."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    given = rows.drop("lot")
    for lot in range(LOTS):
        rows.filter(F.col("lot") == lot).drop("lot").write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/in")
        start(spark.readStream.schema(given.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


def _appended(results: DataFrame, folder: str, **trigger):
    return results.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


@contextmanager
def _rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def timed(s, d) -> DataFrame:
    return lake(s, d).withColumn("ts", F.col("timestamp").cast("timestamp"))


def recorded(s, d) -> DataFrame:
    """SS1, SNK1: lines come in three lots; the first batch is run twice, as after a lost driver, from the files that had come by then."""
    rows = lines(s, d).withColumn("lot", F.col("line_number") % LOTS)

    def start(stream, folder):
        query = st.validate_stream(stream, f"{folder}/valid", f"{folder}/rejected", f"{folder}/state", "live")
        query.awaitTermination()
        if query.lastProgress and query.lastProgress.batchId == 0:
            st.recorder(f"{folder}/valid", f"{folder}/rejected", "live")(s.read.parquet(f"{folder}/in"), 0)
        return query

    folder = arriving(rows, "recorded", start)
    valid = e.parsed(s.read.schema("line string, batch_id bigint, event_type string").json(f"{folder}/valid"))
    kept = valid.groupBy("batch_id", "event_type", F.lower(e.text("telemetry_environment")).alias("outcome")).agg(F.count("*").alias("events"))
    rejected = s.read.schema("reason string, batch_id bigint").json(f"{folder}/rejected").groupBy("batch_id", F.lit(None).cast("string").alias("event_type"), F.col("reason").alias("outcome")).agg(F.count("*").alias("events"))
    return kept.unionByName(rejected)


def deduplicated(s, d) -> DataFrame:
    """SS2: every twentieth event comes again with the next lot."""
    rows = timed(s, d).select("event_id", "event_type", "ts", F.expr(LOT).alias("lot"))
    again = rows.filter("CAST(event_id AS BIGINT) % 20 = 1").withColumn("lot", F.least(F.col("lot") + 1, F.lit(LOTS - 1)))
    folder = arriving(rows.unionByName(again), "deduplicated", lambda stream, f: _appended(st.deduplicated(stream, "100 days"), f))
    return s.read.parquet(f"{folder}/out").select("event_id", "event_type")


def windowed(s, d) -> DataFrame:
    """SS3: days, with an hour's patience: late events of days that are over by then don't count."""
    rows = timed(s, d).select("event_type", "total_latency_ms", "ts", F.expr(LOT).alias("lot"))
    schema = st.windowed(rows.drop("lot"), "1 day", None).schema
    folder = arriving(rows, "windowed", lambda stream, f: st.latest(st.windowed(stream, "1 day", "1 hour"), f"{f}/out", f"{f}/state"))
    return st.last_of(s, f"{folder}/out", schema, "start", "event_type").select(F.to_date("start").cast("string").alias("day"), "event_type", "events")


def previous(s, d) -> DataFrame:
    """SS4: sessions go on from lot to lot; their last language is kept as state."""
    rows = m.queries(timed(s, d)).select("session_id", "event_id", "language", "ts", F.expr(HOURS).alias("lot"))
    folder = arriving(rows, "previous", lambda stream, f: st.carried_language(stream, f"{f}/out", f"{f}/last", f"{f}/state"))
    return s.read.parquet(f"{folder}/out").select("session_id", "event_id", "language", "previous_language")


_LATE = (
    f"rows AS (SELECT event_type, CAST(CAST(timestamp AS DATE) AS STRING) AS day, timestamp, {LOT} AS lot FROM lake), "
    "patience AS (SELECT l.lot, (SELECT max(timestamp) FROM rows r WHERE r.lot < l.lot) - INTERVAL 1 HOUR AS over FROM (SELECT DISTINCT lot FROM rows) l)"
)

QUERIES = {
    "ss01_recorded": (
        recorded,
        f"WITH {LINES_SQL}, {CHECKED} SELECT line_number % 3 AS batch_id, CASE WHEN reason IS NULL THEN json_extract_string(j, '$.event_type') END AS event_type, COALESCE(reason, NULLIF(lower(COALESCE(json_extract_string(j, '$.telemetry_environment'), '')), ''), 'live') AS outcome, count(*) AS events FROM checked GROUP BY ALL",
    ),
    "ss02_deduplicated": (deduplicated, f"WITH {LAKE_SQL} SELECT event_id, event_type FROM lake"),
    "ss03_windowed": (windowed, f"WITH {LAKE_SQL}, {_LATE} SELECT day, event_type, count(*) AS events FROM rows JOIN patience USING (lot) WHERE over IS NULL OR CAST(day AS TIMESTAMP) + INTERVAL 1 DAY > over GROUP BY ALL"),
    "ss04_previous_language": (previous, f"WITH {LAKE_SQL} SELECT session_id, event_id, language, lag(language) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS previous_language FROM lake WHERE event_type IN ('query_completed', 'rag_response')"),
}
