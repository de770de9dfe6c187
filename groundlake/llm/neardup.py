"""Near-duplicates by exact Jaccard similarity of word shingles; candidates by op1's SimHash fingerprints and by banded MinHash."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, text_bytes, written
from .simhash import components, fingerprints, named

WIDTH = 5
LIMIT = 0.8
ROWS, BANDS = 5, 24  # a pair at 0.8 agrees in a band with chance 0.8^5, in none of 24 with chance 7e-5
CHUNK = 1 << 12
LEAST_ALIKE = 79  # of 120 minima; each agrees with chance 0.85 for sets alike by 0.8

_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _draw.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()  # both touch ASCII only: A-Z; space, \t-\r
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e]) for s, e in zip(starts, ends[min(width, len(words)) - 1 :])), dtype="<u8"))


def set_key(hashes: np.ndarray) -> int:
    """64-bit key of a set of shingles: texts of the same key count as copies."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each of ROWS * BANDS functions."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[lo : lo + CHUNK, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, thirty minima to a long: the minima that agree in two sketches bound the sets' similarity."""
    bits = (least >> np.uint64(33)) & np.uint64(3)
    return (bits.reshape(-1, 30) << (2 * np.arange(30, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches_agree(a: str, b: str) -> Column:
    """At least LEAST_ALIKE of the minima agree in their two bits: for sets alike by 0.8 that fails with chance 5e-8."""
    odd = [F.col(a)[i].bitwiseXOR(F.col(b)[i]) for i in range(ROWS * BANDS // 30)]
    differ = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in odd), F.lit(0))
    return differ <= ROWS * BANDS - LEAST_ALIKE


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _prints():
    """Arrow function text -> key of its set of shingles, the keys of its bands and its sketch; an empty set, whose texts are copies of one another, has no bands."""

    @F.arrow_udf("struct<fp:bigint, keys:array<bigint>, sketch:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t) for t in text_bytes(texts)]
        fps = np.array([set_key(s) for s in sets], dtype=np.uint64).view(np.int64)
        least = [minima(s) for s in sets]
        none = np.zeros(0, dtype=np.int64)
        keys, sketches = ([f(m) if len(s) else none for s, m in zip(sets, least)] for f in (bands, sketch))
        return pa.StructArray.from_arrays([pa.array(fps), *(pa.array(c, pa.list_(pa.int64())) for c in (keys, sketches))], ["fp", "keys", "sketch"])

    return run.asNondeterministic()


def _sets():
    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).view(np.int64) for t in text_bytes(texts)], pa.list_(pa.int64()))

    return run.asNondeterministic()


def _alike():
    def each(column: pa.Array) -> list[np.ndarray]:
        edges = column.offsets.to_numpy()
        return np.split(column.flatten().to_numpy(), edges[1:-1] - edges[0])

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y) >= LIMIT for x, y in zip(each(a), each(b))] if len(a) else [], pa.bool_())

    return run.asNondeterministic()


def _candidates(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (u, v) of keys in ``placed`` (fp, root, sketch) that have different roots and can be alike, by prefixes of their sets and sketches.

    Each set is put in one order for all, rarest shingles first. Of two alike sets the first shingle they share is
    followed in either by all the others that they share: 9 * shared >= 4 * (a + b) for sizes a and b, so it lies
    near the front. Pairs meet in such a shingle only; texts edited in many places of their own have none. Texts made of common parts
    meet often, so the join itself compares sketches, and few pairs that aren't alike leave it.
    """
    said = sets.join(placed.select("fp", "root"), "fp").select("fp", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    often = said.groupBy("hash").agg(F.count("*").alias("often"))
    ordered = said.join(often, "hash").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("all"))
    front = ordered.select("fp", "root", "size", F.posexplode(F.slice("all", 1, (F.col("size") / 5 + 1).cast("int"))).alias("at", "x")).filter("x.often > 1")
    front = front.select(F.col("x.hash").alias("hash"), "fp", "root", "size", (F.col("size") - F.col("at")).alias("rest"))
    front = front.join(placed.select("fp", "sketch"), "fp")
    a, b = front.alias("a"), front.alias("b")
    enough = 9 * F.least("a.rest", "b.rest") >= 4 * (F.col("a.size") + F.col("b.size"))
    return a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.fp") > F.col("b.fp")) & (F.col("a.root") != F.col("b.root")) & enough & sketches_agree("a.sketch", "b.sketch")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def _checked(pairs: DataFrame, sets: DataFrame, keep: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """The pairs (u, v) of keys whose sets are alike, written to the shared folder."""
    with small_batches(pairs.sparkSession, 256):
        both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b")), "v")
        return keep(both.filter(_alike()(F.col("a"), F.col("b"))).select("u", "v"), name)


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _alike_prints(rows: DataFrame) -> DataFrame:
    """(fp, k, key): the fingerprint of each set of ``rows`` (fp, keys, sim) and the words it names in op1's covering tables, as buckets after those of the bands.

    Texts of one set may differ in how often they repeat a shingle, and so in their fingerprints; an empty set has none.
    """
    prints = rows.filter(F.size("keys") > 0).select("fp", "sim").distinct()
    words = named(prints.select(F.col("sim").alias("fp")).distinct()).distinct().toDF("sim", "key")
    own = prints.select("fp", F.col("sim").alias("key"))
    return prints.join(words, "sim").select("fp", "key").unionByName(own).distinct().select("fp", F.lit(BANDS).alias("k"), "key")


def roots(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(fp, root) for keys of ``rows`` (text, fp, keys, sketch, sim) that are linked to another; root is the same for all of a component.

    Buckets are the words that fingerprints ``sim`` within two bits have in common, and the bands. Each bucket first compares its members with the one that meets most others in all bands: the text
    that a group of near copies was made from, if it is there. A bucket whose members are in one component by then
    is done: no pair of it can join anything. The members of the others meet by ``_candidates``, which lose no
    alike pair. So the components are those of all pairs of the buckets.
    """
    banded = rows.select("fp", "keys").dropDuplicates(["fp"]).select("fp", F.posexplode("keys").alias("k", "key"))
    keyed = banded.unionByName(_alike_prints(rows))
    crowded = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keep(keyed.join(crowded, ["k", "key"]), "met")
    weighed = met.join(met.groupBy("fp").agg(F.sum("n").alias("meets")), "fp")
    central = weighed.groupBy("k", "key").agg(F.max(F.struct("meets", F.xxhash64("fp").alias("h"), "fp"))["fp"].alias("one"))
    members = keep(met.join(central, ["k", "key"]).select("k", "key", "fp", "one"), "members")
    wanted = members.select("fp").distinct()
    texts = rows.select("fp", "text").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    with small_batches(rows.sparkSession, 1000):
        sets = keep(texts.select("fp", _sets()(F.col("text")).alias("hashes")), "sets")
    first = components(_checked(members.filter("fp <> one").select(*_ordered("fp", "one")).distinct(), sets, keep, "near-one"))
    placed = keep(members.join(first.withColumnRenamed("u", "fp"), "fp", "left").select("k", "key", "fp", F.coalesce("root", "fp").alias("root")), "placed")
    mixed = placed.groupBy("k", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("k", "key")
    sketched = rows.select("fp", "sketch").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])
    pairs = _candidates(sets, placed.join(mixed, ["k", "key"]).select("fp", "root").distinct().join(sketched, "fp"))
    at = placed.select("fp", "root").distinct()
    joined = _checked(pairs, sets, keep, "near-others").join(at.toDF("u", "a"), "u").join(at.toDF("v", "b"), "v").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    second = components(joined).withColumnRenamed("root", "last")
    return keep(at.join(second.withColumnRenamed("u", "root"), "root", "left").select("fp", F.coalesce("last", "root").alias("root")), "roots")


def _classes(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(fp, component_id, one) for each fp of ``rows`` (doc_id, at, text, fp, keys, sketch, sim); ``one`` is the ``at`` of its component's first row.

    First is the row of the smallest doc_id, rows without one last; among equal ids that of the smallest hash of its text.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "at")).alias("first")
    rooted = rows.groupBy("fp").agg(first).join(roots(rows, keep), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(named, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.at").alias("one"))


def _printed(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` with a number, the key of their set of shingles, the keys of its bands and op1's fingerprint: the one pass over all texts."""
    with small_batches(docs.sparkSession, 1000):
        rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"), _prints()(F.col("text")).alias("p"), fingerprints()(F.col("text")).alias("sim"))
        return keep(rows.select("row", "at", "p.fp", "p.keys", "p.sketch", "sim"), "rows").withColumns({"doc_id": F.col("row.doc_id"), "text": F.col("row.text")})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text).

    Texts are linked if the sets of their five-word shingles (ASCII lower case, split at ASCII blanks) have a
    Jaccard similarity of 0.8 or more; every link is checked exactly on the 64-bit hashes of the shingles.
    Candidates are all pairs whose fingerprints are within two bits, as op1 finds them, and those that share a band of a MinHash: another pair at 0.8 is missed with chance 7e-5, a closer one more rarely; their sketches add 5e-8.
    Texts of the same shingles are copies, as are null and empty texts. component_id is the smallest doc_id
    of the component; a null doc_id never names one, and a component of null ids has a null id. Repeated
    rows stay, other columns are ignored, no rows give none. Very long texts are hashed whole, with all of their shingles in memory.

    Scale: links are made on distinct sets; copies are met only by partial aggregation and by joins that
    adaptive execution splits where they are skewed. Sets are kept for texts that share a band only.
    """
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        rows = _printed(docs.select("doc_id", "text"), keep)
        return written(rows.select("doc_id", "fp").join(_classes(rows, keep), "fp").select("doc_id", "fp", "component_id"), "near-classes")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, columns as they were.

    It is the row of the smallest doc_id, or of none if no row has one; among rows of one id that of the smallest hash
    of its text, and of equal rows any. Null and empty texts are one component. Other columns may have any names.

    Scale: the text is hashed once, into a written copy of the rows; rows to drop are found by number, so that
    they are sent to all tasks only where Spark's own limit for that allows it, and else joined.
    """
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        rows = _printed(docs, keep)
        dropped = keep(rows.select("at", "fp").join(_classes(rows, keep), "fp").filter("at <> one").select("at"), "dropped")
        return written(rows.join(dropped, "at", "left_anti").select("row.*"), "kept")
