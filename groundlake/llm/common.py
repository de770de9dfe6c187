"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a local folder is made if all of Spark is one process; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="groundlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    return kept(df, shared_dir(df.sparkSession, name))


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """``keep(df, part)`` writes and rereads a table as ``written`` does; all of them are deleted in the end."""
    folder = shared_dir(spark, name)
    try:
        yield lambda df, part: kept(df, f"{folder}/{part}")
    finally:
        deleted(spark, folder)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside: texts of a batch are in a worker's memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id counts as held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def open_output(uri: str):
    """Binary output stream on any file system that pyarrow knows, and a function that puts the file in place.

    The stream writes under a name of this attempt; ``commit()`` moves it to its final name, so a
    task that is run again after a lost executor replaces the file as a whole.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    stream = system.open_output_stream(part, compression=None)

    def commit() -> None:
        stream.close()
        system.move(part, path)

    return stream, commit


def open_input(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
