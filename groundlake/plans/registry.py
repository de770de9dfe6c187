"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, corpus, details, ingest, retrieval, streams, telemetry

PARTS = (telemetry, ingest, corpus, retrieval, details, checks, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for part in PARTS for k, (q, _) in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for part in PARTS for k, (_, s) in part.QUERIES.items() if s}
