import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from groundlake.llm import neardup
from groundlake.llm.common import documents

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """(doc_id, smallest doc_id of the component) of each row, from all pairs of distinct sets of shingles."""
    sets = {brute_set(t) for _, t in rows}
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in combinations(sets, 2):
        both = len(a & b)
        if a and b and both >= 0.8 * (len(a) + len(b) - both):
            parent[find(a)] = find(b)
    ids = defaultdict(list)
    for d, t in rows:
        ids[find(brute_set(t))] += [] if d is None else [d]
    return Counter((d, min(ids[find(brute_set(t))], default=None)) for d, t in rows)


def result(df):
    return Counter((r.doc_id, r.component_id) for r in df.collect())


def test_components_are_brute_force(spark, odd, none):
    assert result(neardup.near_duplicates(odd)) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert neardup.near_duplicates(none).count() == 0
    docs = documents(spark, SF)
    assert result(neardup.near_duplicates(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_stage_drops_planted_edited_copies_and_keeps_what_is_under_the_threshold(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(40):
        words = [word() for _ in range(190)]
        copy, far = list(words), list(words)
        for k in range(3):  # 15 of 186 shingles: similarity 0.85
            copy[20 + 60 * k] = word()
        for k in range(6):  # 30 of 186 shingles: similarity 0.72
            far[10 + 30 * k] = word()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {d for d, _ in rows if d % 3 != 1}


def test_edited_copies_without_their_source_link_as_all_pairs_do(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, source = [], [word() for _ in range(120)]
    for i in range(300):
        words = list(source)
        for _ in range(draw.choice([1, 1, 2, 3, 4, 6])):
            words[draw.randrange(120)] = word()
        rows.append((i, " ".join(words[draw.randrange(3) :])))
    rows += [(i, t) for i, (_, t) in enumerate(rows[:20], 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_components(rows)
    assert result(neardup.near_duplicates(docs)) == want and len({c for _, c in want}) > 5


def test_candidates_hold_every_alike_pair(spark):
    draw = random.Random(10)
    sets = []
    for _ in range(60):
        base = draw.sample(range(5000), draw.randrange(4, 60))
        sets += [frozenset([*draw.sample(base, max(1, len(base) - draw.randrange(4))), *draw.sample(range(5000), draw.randrange(3))]) for _ in range(5)]
    sets = sorted(set(sets), key=sorted)
    hashed = {x: random.Random(x).getrandbits(64) for s in sets for x in s}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(hashed[x]) for x in s], i, neardup.sketch(neardup.minima(np.array([hashed[x] for x in s], dtype=np.uint64))).tolist()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "fp bigint, hashes array<bigint>, root bigint, sketch array<bigint>")
    found = {(r.u, r.v) for r in neardup._candidates(table.select("fp", "hashes"), table.select("fp", "root", "sketch")).collect()}
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)}
    assert alike and alike <= found and len(found) < 3 * len(alike)


def test_texts_of_common_parts_make_few_candidates(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    pool = [" ".join(word() for _ in range(9)) for _ in range(30)]
    texts = [" ".join(draw.sample(pool, 10)) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", neardup._prints()(F.col("text")).alias("p")).select("text", "p.*")
    sets = rows.select("fp", neardup._sets()(F.col("text")).alias("hashes"))
    before = sum(len(a & b) > 0 for a, b in combinations([brute_set(t) for t in texts[:200]], 2)) * 100
    assert neardup._candidates(sets, rows.select("fp", F.col("fp").alias("root"), "sketch")).count() < before / 1000


def test_fingerprints_of_op1_name_candidates(spark, monkeypatch):
    """Without any band, alike texts are found whose fingerprints are within two bits; texts of one fingerprint that aren't alike stay apart."""
    monkeypatch.setattr(neardup, "bands", lambda least: np.frombuffer(os.urandom(8), "<i8"))  # no two texts share one
    refrain, ends = "a b c " * 100, ["".join(f"{x}{i} " for i in range(9)) for x in "xy"]
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, refrain + ends[0]), (2, refrain + ends[1]), (3, long + " one"), (4, long + " two"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(neardup.near_duplicates(docs)) == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 3): 1, (5, 5): 1, (6, 5): 1})
