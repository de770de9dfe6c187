"""Lexical, dense and hybrid search over tables of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import mean, rounded, valid_vector
from . import lexical
from .lexical import top_k

RRF_K = 60


def metadata_filter(**wanted) -> Column:
    """PRJ10: all given fields equal; none given lets every row pass. Page numbers start at 1."""
    if wanted.get("page_number") is not None and wanted["page_number"] < 1:
        raise ValueError("page_number starts at 1")
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None], F.lit(True))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int = 12, where: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """JB12 on a table that has no stored index yet: one is built, then searched; see ``lexical``. The filter acts before the cut."""
    return lexical.search(lexical.build(chunks), queries, k, None if where is None else chunks.filter(where), min_score)


def _units(vectors: pa.Array, size: int) -> np.ndarray:
    """A matrix of the vectors over their lengths; a zero vector stays."""
    rows = np.array(vectors.to_pylist(), dtype=np.float64).reshape(len(vectors), size)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1e-9, norms)


def _packed(table: DataFrame, name: str, size: int, rows: int) -> DataFrame:
    """(``name``_ids, ``name``_matrix): the table's valid vectors as blocks of at most ``rows`` unit vectors, where its rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([_units(part.column(1), size).tobytes()], pa.binary())], ["ids", "matrix"])

    kept = table.filter(valid_vector(F.col("embedding"), size) & F.col(f"{name}_id").isNotNull())
    return kept.select(F.col(f"{name}_id").cast("bigint"), "embedding").mapInArrow(run, "ids array<bigint>, matrix binary").withColumnsRenamed({"ids": f"{name}_ids", "matrix": f"{name}_matrix"})


def _best(places: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query's place, id, score) of each place; smaller ids first on ties."""
    order = np.lexsort((ids, -scores, places))
    places, ids, scores = places[order], ids[order], scores[order]
    kept = np.arange(len(places)) - np.searchsorted(places, places) < k
    return places[kept], ids[kept], scores[kept]


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 12, min_score: float = 0.0, block_rows: int = 1024, held_blocks: int = 64) -> DataFrame:
    """JB13, JN4, UF3, MT2: cosine in 0..1, top k; query_id, chunk_id, dense_score, rank.

    ``queries`` (query_id, embedding) and ``vectors`` (chunk_id, embedding) become blocks of ``block_rows`` rows, at most 4 MB, where they are
    read. Every block of queries meets every block of vectors, and a task passes on k rows a query of the up to ``held_blocks`` blocks of
    queries it holds; no vector passes through the driver. Rows without an id and vectors that are null, hold a number that
    isn't finite, or are shorter than the longest query are left out on either side.
    """
    size, asked = queries.agg(F.coalesce(F.greatest(F.lit(0), F.max(F.size("embedding"))), F.lit(0)), F.count("*")).first()
    rows = max(1, min(block_rows, (4 << 20) // (8 * max(1, size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def found(key: bytes) -> pa.RecordBatch:
            places, ids, scores = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)[places]), pa.array(ids), pa.array(scores)], ["query_id", "chunk_id", "dense_score"])

        for batch in batches:
            for q_ids, q_matrix, c_ids, c_matrix in zip(*(batch.column(c) for c in ("query_ids", "query_matrix", "chunk_ids", "chunk_matrix"))):
                key, names = q_ids.values.to_numpy().tobytes(), c_ids.values.to_numpy()
                wanted, there = (np.frombuffer(m.as_buffer(), np.float64).reshape(-1, size) for m in (q_matrix, c_matrix))
                scores = np.floor(np.clip(wanted @ there.T, 0, 1) * 10000 + 0.5) / 10000
                cut = np.partition(scores, -k, axis=1)[:, -k, None] if len(names) > k else -1.0
                places, at = np.nonzero(scores >= cut)
                new = places, names[at], scores[places, at]
                held[key] = _best(*(np.concatenate(both) for both in zip(held[key], new)), k) if key in held else _best(*new, k)
                if len(held) > held_blocks:
                    yield found(next(iter(held)))
        yield from map(found, list(held))

    blocks = _packed(queries, "query", size, rows).repartition(max(1, asked // (rows * 16)))
    pairs = _packed(vectors, "chunk", size, rows).crossJoin(blocks)
    return top_k(pairs.mapInArrow(run, "query_id bigint, chunk_id bigint, dense_score double"), k, "dense_score").filter(F.col("dense_score") >= min_score)


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables, dealt anew by candidate: inputs that are dealt by query may differ in their
    partitions after adaptive coalescing, and a grouping right on their union would then miss matches."""
    return reduce(DataFrame.unionByName, others, first).repartition("query_id", "chunk_id")


def merge_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """JN5, ST1: one row a candidate with its best scores and the methods that found it."""
    none = F.lit(None).cast("double")
    both = stacked(dense.select("query_id", "chunk_id", "dense_score", none.alias("lexical_score"), F.lit("dense").alias("m")), lexical.select("query_id", "chunk_id", none.alias("dense_score"), "lexical_score", F.lit("lexical").alias("m")))
    return both.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score"), F.max("lexical_score").alias("lexical_score"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("methods"))


def _ranked(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    return stacked(dense.select("query_id", "chunk_id", "rank", F.lit("dense").alias("method")), lexical.select("query_id", "chunk_id", "rank", F.lit("lexical").alias("method")))


def rrf(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """MT3: sum of 1 / (60 + rank)."""
    return _ranked(dense, lexical).groupBy("query_id", "chunk_id").agg(rounded(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("rrf_score"))


def weighted_rrf(dense: DataFrame, lexical: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """MT4: weighted, over the query's best; ties by dense, lexical score and chunk, all falling."""
    weight = F.when(F.col("method") == "dense", weights[0]).otherwise(weights[1])
    raw = _ranked(dense, lexical).groupBy("query_id", "chunk_id").agg(F.sum(weight / (RRF_K + F.col("rank"))).alias("raw"))
    scored = raw.withColumn("rrf_score", rounded(F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")), 4)).drop("raw").join(merge_candidates(dense, lexical), ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc(F.coalesce("dense_score", F.lit(0.0))), F.desc(F.coalesce("lexical_score", F.lit(0.0))), F.desc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order))


def best_rank_rrf(ranked: DataFrame) -> DataFrame:
    """MT5, WN3: over variants: 1 / (60 + best rank) and a ten-thousandth for each further variant that found it."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"), F.countDistinct("variant").alias("n")).withColumn("fused_score", rounded(1 / (RRF_K + F.col("best_rank")) + (F.col("n") - 1) * 1e-4, 6)).drop("n")


def multi_variant_search(dense: DataFrame, lexical_: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """JB15: the lists of each variant of a query, fused to one a query: query_id, chunk_id, best_rank, dense_score, lexical_score,
    methods, variants, rrf_score, hybrid_score, rank.

    ``dense`` and ``lexical_`` have query_id, variant, chunk_id, rank and their score. Each variant gives a hybrid list of ``pool`` (JB14);
    a chunk counts by its best rank, with a ten-thousandth of its best scores to part ties, then falls to the chunk's id. ``max(k, pool)`` stay.
    """
    key = F.to_json(F.struct("query_id", "variant"))
    a, b = (t.withColumn("query_id", key) for t in (dense, lexical_))
    listed = top_k(rrf(a, b), pool, "rrf_score").select("query_id", "chunk_id", "rank")
    scored = listed.join(merge_candidates(a, b), ["query_id", "chunk_id"]).withColumn("of", F.from_json("query_id", "query_id string, variant string"))
    one = scored.select(F.col("of.query_id").cast(dense.schema["query_id"].dataType).alias("query_id"), F.col("of.variant").alias("variant"), "chunk_id", "rank", "dense_score", "lexical_score", F.explode(F.split("methods", ",")).alias("method"))
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    fused = one.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best_rank"), F.max("dense_score").alias("dense_score"), F.max("lexical_score").alias("lexical_score"), sorted_set("method").alias("methods"), sorted_set("variant").alias("variants"))
    base = 1 / (RRF_K + F.col("best_rank"))
    score = base + (F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("dense_score", F.lit(0.0))) * 1e-4
    return top_k(fused.withColumns({"rrf_score": rounded(base, 6), "hybrid_score": rounded(score, 6)}), max(k, pool), "hybrid_score")


def linear_fusion(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """MT6: weighted mean of scores in 0..1; shorter texts first on ties, then falling chunk ids."""
    total = sum(weights)
    mixed = (weights[0] * F.coalesce("dense_score", F.lit(0.0)) + weights[1] * F.coalesce("lexical_score", F.lit(0.0))) / total
    scored = merge_candidates(dense, lexical).withColumn("hybrid_score", rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "text_length", F.desc("chunk_id"))
    return hydrate(scored, chunks.select("chunk_id", F.length("text").alias("text_length"))).withColumn("rank", F.row_number().over(order))


def hydrate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN6."""
    return candidates.join(chunks, "chunk_id", "left")


def hybrid_search(dense: DataFrame, lexical: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """JB14: the plain sum of both lists, cut to the pool and to the k best."""
    return top_k(top_k(rrf(dense, lexical), pool, "rrf_score").drop("rank"), k, "rrf_score")


def coverage(query: Column, text: Column) -> Column:
    """ST3: share of the query's distinct words that the text holds."""
    return F.size(F.array_intersect(query, text)) / F.greatest(F.lit(1), F.size(F.array_distinct(query)))


# Words of the rerank rules.
GENERIC_WORDS = (
    "what is the in for to of and a an on are how do does did explain about which where can be who whom whose when why won was were been have has tell me used with from at by use using mentioned any some give detail details system platform "
    "student students faculty shall must only per as such required requirement requirements need needed rules rule guidelines guideline policy applicable apply instruction instructions procedure course courses registered"
).split() + ["registered courses"]
CORE_TERMS = (
    "database mysql backend frontend technology technologies stack proctoring security desktop electron services attendance condonation credit credits revaluation photocopy challenge supplementary makeup fast-track backlog "
    "scholarship merit hostel placement debarment eligibility grade malpractice express jwt rbac cloudflare gemini openai html5 css3 javascript python vision proctor cgtmse guarantee scheme msme website portal url nirf fee fees "
    "curfew deposit caution stipend shortage 75% 65% 88 distinction cgpa"
).split()


def rerank(candidates: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """JB17: candidates (query_id, query, chunk_id, text, section_title, rrf_score) with rerank_score and rank.

    0.40 rank score + 0.40 word coverage + 0.25 names + 0.20 intent + 0.15 section + 0.25 domain word + 0.20 phrase, less 0.60 where a
    domain question meets none of its words and 0.20 or 0.05 for short texts.
    """
    generic = generic or GENERIC_WORDS
    stems = lambda tokens: F.array_distinct(F.concat(tokens, F.transform(tokens, tx.stem)))
    lower = F.lower("text")
    section = F.lower(F.coalesce("section_title", F.lit("")))
    raw = tx.tokenize(F.col("query"))
    rows = candidates.withColumn("raw", raw).withColumn("telling", F.filter("raw", lambda t: ~t.isin(*generic)))
    rows = rows.withColumn("core", F.when(F.size("telling") > 0, F.col("telling")).otherwise(F.col("raw"))).withColumn("tokens", F.array_distinct(tx.tokenize(F.col("text")))).withColumn("names", F.transform(tx.entities(F.col("query")), F.lower))
    matched = F.size(F.array_intersect(stems(F.col("core")), stems(F.col("tokens"))))
    named = F.size(F.filter("names", lambda x: F.contains(lower, x) | F.contains(section, x)))
    holds = lambda where, *phrases: reduce(lambda a, b: a | b, [F.contains(where, F.lit(p)) for p in phrases])
    points = lambda flag, p: F.when(flag, p).otherwise(0.0)
    intent = tx.query_intent(F.col("query"))
    same_number = F.arrays_overlap(tx.numbers(F.col("query")), tx.numbers(F.col("text")))
    fits = (
        F.when(intent == "NUMERICAL", F.when(same_number, 0.35).when(F.size(tx.numbers(F.col("text"))) > 0, 0.2).otherwise(0.0) + points(holds(lower, "fee", "attendance", "credits", "limit", "amount", "concession"), 0.15))
        .when(intent == "WHERE_TO", points(holds(lower, "http", "www."), 0.4) + points(holds(lower, "official", "portal", "website"), 0.25))
        .when(intent == "HOW_TO", points(holds(section, "how to apply", "procedure", "process"), 0.35) + points(holds(lower, "step", "apply through", "submission", "portal"), 0.2))
        .when(intent == "POLICY", points(holds(section, "policy", "regulations", "rules", "attendance", "hostel", "discipline", "curfew", "malpractice"), 0.3))
        .otherwise(0.0)
    )
    domain = F.array_intersect("core", tx.words(CORE_TERMS))
    scope = points(F.arrays_overlap(stems(F.col("core")), stems(tx.tokenize(section))), 0.3)
    length = F.length(tx.strip(F.col("text")))
    question = F.lower("query")
    score = (
        F.col("rrf_score") * 0.4 + matched / F.greatest(F.lit(1), F.size("core")) * 0.4 + F.when(F.size("names") > 0, named / F.size("names")).otherwise(0.0) * 0.25 + fits * 0.2 + scope * 0.15
        + points(F.arrays_overlap(domain, F.col("tokens")), 0.25) + points((F.length(question) > 4) & F.contains(lower, question), 0.2)
        - points((F.size(domain) > 0) & (matched == 0) & (named == 0), 0.6) - F.when(length < 80, 0.2).when(length < 120, 0.05).otherwise(0.0)
    )
    scored = rows.withColumn("raw_score", rounded(score, 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), F.desc("rrf_score"), F.desc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_score"))).alias("rerank_score"), "rank")


def invalid_candidates(candidates: DataFrame) -> DataFrame:
    """PRJ15: candidates with the names of what is wrong with them: blank ids or text, a page under 1, scores outside 0..1; absent columns aren't checked."""
    blank = lambda c: tx.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    outside = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    rules = {"chunk_id": blank, "doc_id": blank, "text": blank, "page_number": lambda c: F.coalesce(F.col(c) < 1, F.lit(True))} | dict.fromkeys(("dense_score", "lexical_score", "hybrid_score", "rerank_score"), outside)
    wrong = F.array_compact(F.array(*[F.when(rule(c), c) for c, rule in rules.items() if c in candidates.columns]))
    return candidates.withColumn("faults", F.array_join(wrong, ",")).filter("faults <> ''")


def gold_hits(results: DataFrame, gold: DataFrame) -> DataFrame:
    """JN13: (query_id, rank) of results that stand in ``gold`` (query_id, chunk_id)."""
    return results.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").select("query_id", "rank")


def lenient_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """JN13: (query_id, rank, doc_hit) of results (query_id, rank, doc_id, text) from an expected document, or whose text holds, anywhere in it, a
    word of over three letters of an expected point; ``expected``: query_id, doc_ids (array), points (array of texts)."""
    words = F.flatten(F.transform(F.coalesce("points", F.array().cast("array<string>")), lambda p: F.filter(F.split(F.lower(p), r"\s+"), lambda w: F.length(w) > 3)))
    met = results.join(expected.select("query_id", "doc_ids", F.array_distinct(words).alias("words")), "query_id")
    doc_hit = F.coalesce(F.array_contains("doc_ids", F.col("doc_id")), F.lit(False))
    lower = F.lower(F.coalesce("text", F.lit("")))
    return met.withColumn("doc_hit", doc_hit).filter(F.col("doc_hit") | F.exists("words", lambda w: F.contains(lower, w))).select("query_id", "rank", "doc_hit")


def evaluate(queries: DataFrame, hits: DataFrame, *by: str, runs: DataFrame | None = None) -> DataFrame:
    """JB27, AG29: hits at 1, 3, 5 and the mean reciprocal rank of ``queries`` (query_id, *by) from their ``hits`` (query_id, rank).

    With ``runs`` (query_id, latency_ms, variants; a row a query) also their means. At most k rows a query are read: who asks
    whether results are right joins what is known of them, and makes no pairs of queries and right answers.
    """
    first = hits.groupBy("query_id").agg(F.min("rank").alias("hit"))
    rate = lambda c: rounded(F.avg(c), 4)
    at = lambda n: rate(F.when(F.col("hit") <= n, 1.0).otherwise(0.0)).alias(f"hit_at_{n}")
    rows, means = queries.join(first, "query_id", "left"), []
    if runs is not None:
        rows, means = rows.join(runs.select("query_id", "latency_ms", "variants"), "query_id", "left"), [F.coalesce(rounded(mean(c), 2), F.lit(0.0)).alias(f"avg_{c}") for c in ("latency_ms", "variants")]
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), at(1), at(3), at(5), rate(F.coalesce(1 / F.col("hit"), F.lit(0.0))).alias("mrr"), *means)
