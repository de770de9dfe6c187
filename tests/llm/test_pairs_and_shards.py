import zlib
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

SF = "/root/testdata/sf0.001"


import pytest

from groundlake.llm import sharding, simhash
from groundlake.llm.common import documents


def brute_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(rows):
    """(doc_id, fingerprint, root, smallest doc_id of the root's component) of each row."""
    prints = [brute_print(t) for _, t in rows]
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(sorted(parent), 2):
        if bin(a ^ b).count("1") <= 2:
            parent[find(a)] = find(b)
    ids = defaultdict(list)
    for (d, _), p in zip(rows, prints):
        ids[find(p)] += [] if d is None else [d]
    return [(d, f"{p:016x}", find(p), min(ids[find(p)], default=None)) for (d, _), p in zip(rows, prints)]


def brute_components(rows):
    return Counter((d, p, first) for d, p, _, first in brute_roots(rows))


def result(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_simhash_is_brute_force_on_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(odd)) == brute_components(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_is_brute_force_on_documents(spark):
    docs = documents(spark, SF)
    assert result(simhash.near_duplicates(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_covering_masks_cover_all_pairs_of_positions():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_links_join_exactly_what_is_within_two_bits(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (1 << 63) ^ (5 << 40), base ^ (0xFF << 20), 0, 1 << 63]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    for r in edges.collect():
        assert bin((r.u ^ r.v) & (2**64 - 1)).count("1") in (1, 2)
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    named = [roots.get(p, p) for p in signed]
    assert len(set(named[:6])) == 1 and named[6] not in named[:6] and named[7] == named[8] != named[6]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "u bigint, v bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_keep_one_leaves_one_row_a_component(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    wanted = {root: first for _, _, root, first in brute_roots(rows)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(wanted.values())


def check_ring(docs, shards):
    rows = sharding.shard_documents(docs, shards=shards, rows_per_bucket=16).collect()
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    wanted = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == wanted
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}
    return {r.doc_id: r.shard for r in rows}


def test_ring_is_balanced_and_whole(spark, odd, none):
    check_ring(odd, 16)
    check_ring(odd, 3)
    check_ring(documents(spark, SF), 16)
    assert sharding.shard_documents(none).count() == 0


def test_growing_the_ring_moves_few_documents(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    before, after = check_ring(docs, 16), check_ring(docs, 17)
    assert sum(before[d] != after[d] for d in before) < 0.3 * len(before)  # a fresh deal would move 94 of 100


def test_keys_that_fit_stay_at_their_first_shard(spark):
    moved = sharding.shard_documents(spark.range(5000).selectExpr("id AS doc_id", "'' AS text"), shards=4, vnodes=128)
    assert moved.filter("moved").count() < 500


def brute_walk(spark, docs, shards, vnodes):
    """(doc_id, shard, slot) of each row: keys wait in a list, which is carried round the ring point by point."""
    text = "coalesce(text, '')"
    rows = docs.selectExpr("doc_id", f"xxhash64('key', doc_id, crc32(cast({text} as binary))) AS h").collect()
    points = sorted((r.x, r.id, r.id % shards) for r in spark.range(shards * vnodes).selectExpr("id", f"shiftrightunsigned(xxhash64('node', id % {shards}, id div {shards}), 32) AS x").collect())
    room = {s: len(rows) // shards + (s < len(rows) % shards) for s in range(shards)}
    held, waiting, used = defaultdict(list), [], Counter()
    for r in rows:
        x = r.h % (1 << 64) >> 32
        k = next((k for k, p in enumerate(points) if x <= p[0]), 0)
        held[k].append(((x if x <= points[-1][0] else x - (1 << 32)), r.h, r.doc_id))
    demand, found, turned = Counter({s: 0 for s in range(shards)}), [], defaultdict(list)
    for k, keys in held.items():
        demand[points[k][2]] += len(keys)
    for k, (_, _, shard) in enumerate(points):
        for key in sorted(held[k]):
            if used[shard] < room[shard]:
                found.append((key[2], shard, used[shard]))
                used[shard] += 1
            else:
                turned[k].append(key)
    for turn in range(2):
        for k, (_, _, shard) in enumerate(points):
            waiting += turned[k] if turn == 0 else []
            while waiting and used[shard] < room[shard]:
                found.append((waiting.pop(0)[2], shard, used[shard]))
                used[shard] += 1
    assert not waiting
    return Counter(found)


@pytest.mark.parametrize("n,shards,vnodes", [(1000, 4, 8), (777, 5, 3), (64, 16, 1), (3, 4, 2)])
def test_ring_is_a_walk_from_point_to_point(spark, n, shards, vnodes):
    docs = spark.range(n).selectExpr("id * 13 AS doc_id", "CAST(id AS string) AS text")
    rows = sharding.shard_documents(docs, shards, vnodes, rows_per_bucket=16).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in rows) == brute_walk(spark, docs, shards, vnodes)
