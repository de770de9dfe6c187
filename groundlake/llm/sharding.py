"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32
CELLS_SHIFT = 20


def _virtual_nodes(spark, shards: int, vnodes: int) -> DataFrame:
    """(node, shard, x): the shards x vnodes points of the ring in clockwise order; bounded by the parameters."""
    points = spark.range(shards * vnodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), 32).alias("x"),
        "id",
    )
    return points.select((F.row_number().over(Window.orderBy("x", "id")) - 1).cast("int").alias("node"), "shard", "x")


def _arcs(nodes: DataFrame) -> DataFrame:
    """(cell, lo, hi, node): the arc lo < x <= hi that a point owns, cut at cells of equal width so that a lookup is an equi-join.

    Keys beyond the last point wrap round: their place is negative, so that every arc is one interval.
    """
    everyone = Window.partitionBy()
    arcs = nodes.select(
        "node",
        F.coalesce(F.lag("x").over(Window.orderBy("node")), F.max("x").over(everyone) - RING).alias("lo"),
        F.col("x").alias("hi"),
    ).filter("lo < hi")
    first, last = F.shiftright(F.col("lo"), CELLS_SHIFT), F.shiftright(F.col("hi"), CELLS_SHIFT)
    return arcs.withColumn("cell", F.explode(F.sequence(first, last)))


def _takes(loads: DataFrame) -> DataFrame:
    """(nth, shard, slot0, take): how many of the keys that wait each point takes, in the order in which the walk passes them.

    The walk starts with the first point of the ring and goes round twice; the second time nothing joins the queue. It
    is a fold over one row of points, as large as the parameters make it.
    """
    free = F.greatest(F.lit(0).cast("long"), F.col("cap") - F.col("demand")).alias("free")
    ring = loads.agg(
        F.array_sort(F.collect_list(F.struct("node", "shard", "over"))).alias("ring"),
        F.array_sort(F.collect_set(F.struct("shard", "cap", free))).alias("rooms"),
    )
    again = F.transform("ring", lambda x: F.struct(x["node"].alias("node"), x["shard"].alias("shard"), F.lit(0).cast("long").alias("over")))
    nothing = F.array().cast("array<struct<shard:int,slot0:bigint,take:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("queue"), F.transform("rooms", lambda r: r["free"]).alias("free"), nothing.alias("takes"))

    def step(state, x):
        place = F.element_at(state["free"], x["shard"] + 1)
        take = F.least(state["queue"] + x["over"], place)
        slot0 = F.element_at(F.col("rooms"), x["shard"] + 1)["cap"] - place
        return F.struct(
            (state["queue"] + x["over"] - take).alias("queue"),
            F.transform(state["free"], lambda v, i: F.when(i == x["shard"], v - take).otherwise(v)).alias("free"),
            F.when(take > 0, F.concat(state["takes"], F.array(F.struct(x["shard"].alias("shard"), slot0.alias("slot0"), take.alias("take"))))).otherwise(state["takes"]).alias("takes"),
        )

    walked = ring.select(F.aggregate(F.concat("ring", again), start, step)["takes"].alias("takes"))
    return walked.select(F.posexplode("takes").alias("nth", "t")).select("nth", "t.*")


def _pieces(nodes: DataFrame, arrivals: DataFrame, total: int, shards: int) -> DataFrame:
    """(node, lo, hi, shard, slot0): where the keys of rank lo <= rank < hi in the arc of a point go.

    Works on one row per point only. A shard takes its own keys in ring order until it is full; keys beyond that
    wait in the order of the ring, and each point that the walk passes takes of them what its shard has room for.
    """
    own, everyone = Window.partitionBy("shard").orderBy("node"), Window.partitionBy()
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    nothing = F.lit(0).cast("long")
    loads = (
        nodes.join(arrivals, "node", "left")
        .select("node", "shard", F.coalesce("n", nothing).alias("n"), cap.cast("long").alias("cap"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(before), nothing))
        .withColumn("demand", F.sum("n").over(Window.partitionBy("shard")))
        .withColumn("home", F.least("n", F.greatest(nothing, F.col("cap") - F.col("earlier"))))
        .withColumn("over", F.col("n") - F.col("home"))
        .withColumn("over0", F.sum("over").over(Window.orderBy("node")) - F.col("over"))
    )
    takes = _takes(loads).withColumn("queue0", F.sum("take").over(Window.orderBy("nth")) - F.col("take"))
    home = loads.select("node", nothing.alias("lo"), F.col("home").alias("hi"), "shard", F.least("cap", "earlier").alias("slot0"))
    source = F.struct("node", "home", "over0")
    target = F.struct("shard", "slot0", "queue0")
    marks = loads.filter("over > 0").select(F.col("over0").alias("x"), source.alias("source"), F.lit(None).cast("struct<shard:int,slot0:bigint,queue0:bigint>").alias("target"), (F.col("over0") + F.col("over")).alias("end")).unionByName(
        takes.select(F.col("queue0").alias("x"), F.lit(None).cast("struct<node:int,home:bigint,over0:bigint>").alias("source"), target.alias("target"), (F.col("queue0") + F.col("take")).alias("end"))
    )
    by_x = Window.orderBy("x")
    steps = (
        marks.groupBy("x")
        .agg(F.max("source").alias("source"), F.max("target").alias("target"), F.max("end").alias("end"))
        .select(
            "x",
            F.coalesce(F.lead("x").over(by_x), F.max("end").over(everyone)).alias("to"),
            F.last("source", ignorenulls=True).over(by_x).alias("s"),
            F.last("target", ignorenulls=True).over(by_x).alias("t"),
        )
    )
    moved = steps.select(
        F.col("s.node").alias("node"),
        (F.col("s.home") + F.col("x") - F.col("s.over0")).alias("lo"),
        (F.col("s.home") + F.col("to") - F.col("s.over0")).alias("hi"),
        F.col("t.shard").alias("shard"),
        (F.col("t.slot0") + F.col("x") - F.col("t.queue0")).alias("slot0"),
    )
    return home.unionByName(moved).filter("lo < hi")


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 64, rows_per_bucket: int = 8192) -> DataFrame:
    """Deal ``docs`` (doc_id, text) to ``shards`` shards whose row counts are at most one apart (law ``rows``).

    Every document has a place on a ring (a hash of its id and of its text's checksum) and belongs to
    the next virtual node clockwise. A shard holds N/shards rows, rounded up for the first N mod shards
    shards: the bounded load. A shard keeps its own keys in the order of the ring until it is full. Keys beyond that
    continue clockwise: a walk from the ring's first point goes round twice, and at each point the keys that wait, first
    come first, take the places that the point's shard has left, so no key passes a shard with room.
    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (0.. without gaps in a shard),
    grown_shard (always null: growing moves rows between old shards too) and moved (not at its first shard).

    Null texts count as empty; a null doc_id is hashed as no value; repeated rows get slots of their
    own, keys at one place of the ring stand in the order of id and size; very long texts count by their size
    alone; an empty table gives no rows; other columns are ignored.

    Scale: the rows move once, as (id, size, checksum). Ranks in an arc come from counts of buckets of
    about ``rows_per_bucket`` rows plus a row number inside each bucket, so no window holds more than a
    bucket. The tables joined by broadcast have at most 3 x shards x vnodes + 4096 rows at any input size.
    """
    spark = docs.sparkSession
    total = docs.count()
    bits = min(31, max(0, math.ceil(math.log2(max(1, total / rows_per_bucket)))))
    nodes = _virtual_nodes(spark, shards, vnodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit("key"), "doc_id", "text_crc32"))
    edge = nodes.agg(F.max("x").alias("edge")).first()["edge"]  # one number
    place = F.shiftrightunsigned("h", 32)
    keys = keys.withColumn("x", F.when(place > edge, place - RING).otherwise(place)).withColumn("cell", F.shiftright("x", CELLS_SHIFT))
    arcs = F.broadcast(_arcs(nodes))
    placed = keys.join(arcs, (keys["cell"] == arcs["cell"]) & (keys["x"] > arcs["lo"]) & (keys["x"] <= arcs["hi"])).select(
        "doc_id", "size", "text_crc32", "h", "x", "node", F.shiftright("x", 32 - bits).alias("bucket")
    )
    counts = placed.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    ranks = counts.select("node", "bucket", (F.sum("n").over(Window.partitionBy("node").orderBy("bucket")) - F.col("n")).alias("base"))
    pieces = _pieces(nodes, counts.groupBy("node").agg(F.sum("n").alias("n")), total, shards)
    order = Window.partitionBy("node", "bucket").orderBy("x", "h", "doc_id", "size")
    ranked = placed.withColumn("nth", F.row_number().over(order) - 1).join(ranks, ["node", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))
    p = F.broadcast(pieces.select(F.col("node").alias("at"), "lo", "hi", "shard", "slot0"))
    first = F.broadcast(nodes.select(F.col("node").alias("own"), F.col("shard").alias("own_shard")))
    return (
        ranked.join(p, (ranked["node"] == p["at"]) & (ranked["rank"] >= p["lo"]) & (ranked["rank"] < p["hi"]))
        .join(first, F.col("node") == F.col("own"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            (F.col("shard") != F.col("own_shard")).alias("moved"),
        )
    )
