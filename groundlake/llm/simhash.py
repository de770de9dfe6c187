"""SimHash fingerprints and near-duplicate components by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, kept, shared_dir, text_bytes, written

BITS = 64
CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; a bit is set if it is set in over half of the shingle hashes."""
    words = text.lower().split()  # both touch ASCII only: A-Z; space, \t-\r
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[lo:hi], ends[lo + last : hi + last])), dtype="<u8", count=hi - lo)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(width: int = 3, seed: int = 42):
    """Arrow function text -> fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t, width, seed) for t in text_bytes(texts)], dtype=np.uint64)
        return pa.array(values.view(np.int64))

    return run.asNondeterministic()


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; any two words that differ in at most ``radius`` bits agree under one of them.

    Position i gets a non-zero vector m(i) of radius+1 bits, and mask v keeps the positions whose m(i).v is odd.
    The differing positions give at most ``radius`` linear conditions m(i).v = 0, which leave a non-zero v.
    """
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if bin((1 + i % (size - 1)) & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def named(prints: DataFrame) -> DataFrame:
    """(fp, word): words of which any two distinct fingerprints ``fp`` that differ in one or two bits, and no others, have one in common.

    Covering tables first: a fingerprint goes on only with a table in which its bucket has another.
    Inside a bucket no pairs are made: each member names itself and its one-bit neighbours in the
    positions that the mask leaves open. Members that name the same word are within two bits of each
    other, and two members within two bits always name a common word. A word has at most 65 members.
    """
    masks = covering_masks(2)
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.k", "t.key")
    crowded = keyed.groupBy("k", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("k", "key")
    members = keyed.join(crowded, ["k", "key"]).select("fp", "k")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    return members.select("fp", F.explode(F.element_at(flips, F.col("k") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))


def links(prints: DataFrame) -> DataFrame:
    """Star edges (u, v), u > v, between distinct fingerprints ``fp`` that differ in one or two bits: a star for each word that two of them name."""
    balls = named(prints).groupBy("word").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = balls.select(F.explode("all").alias("u"), F.array_min("all").alias("v"))
    return stars.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with an edge to a smaller one; root is the smallest node it reaches.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.
    The folder of the step before last is deleted.
    """
    spark = edges.sparkSession
    folders = [shared_dir(spark, "edges")]
    now, mark = kept(edges.select("u", "v"), folders[0]), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == mark or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        folders.append(shared_dir(spark, "edges"))
        now = kept(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), folders[-1])
        deleted(spark, folders.pop(0))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex), component_id for every row of ``docs`` (doc_id, text).

    Fingerprints within two bits are linked; component_id is the smallest doc_id in the connected
    component, the document's own included. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows stay. A null doc_id never names a component; a component
    of null ids only has a null id. Other columns are ignored. An empty table gives no rows.

    Scale: graph work runs on distinct fingerprints; copies are met only by partial aggregation and by
    one join on the fingerprint, which adaptive execution splits where it is skewed.
    """
    prints = written(docs.select("doc_id", fingerprints(width)(F.col("text")).alias("fp")), "prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp").distinct()))
    rooted = firsts.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that of its smallest doc_id.

    Among rows of one id it is that of the smallest hash of its text, of equal rows any. A component without any id
    keeps one row. Columns stay as they were, whatever their names; null and empty texts are one component.
    """
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"), fingerprints(width)(F.col("text")).alias("fp")), "rows")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("h"), "at")).alias("first")
    roots = components(links(rows.select("fp").distinct())).withColumnRenamed("u", "fp")
    rooted = rows.groupBy("fp").agg(first).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", F.col("first.at").alias("one"))
    dropped = written(rows.select("at", "fp").join(classes, "fp").filter("at <> one").select("at"), "dropped")
    return rows.join(dropped, "at", "left_anti").select("row.*")
