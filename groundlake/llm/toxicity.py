"""Multiple-instance learning: sentences are scored, a noisy-or of them is trained on labels of whole documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to fit on, at most, chosen by a hash of their ids; features: weights, at most."""

    sample: int = 16_384
    features: int = 4096
    min_docs: int = 4
    steps: int = 400
    l2: float = 1e-4
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)


def word_features(word: str, s: Settings) -> list[str]:
    """The word, and its beginnings: compounds and inflected forms share them."""
    return [word + "$", *(word[:n] for n in s.prefixes if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences that hold a word; a text without any is one empty sentence."""
    return [m.span() for m in SENTENCE.finditer(text) if not m[0].isspace()] or [(0, 0)]


class Sentences:
    """Feature numbers of sentences, by a cache of words."""

    def __init__(self, places: dict[str, int], s: Settings, limit: int = 500_000):
        self.places, self.s, self.limit, self.known = places, s, limit, {}

    def of(self, sentence: str) -> list[int]:
        known, found = self.known, set()
        for w in WORD.findall(sentence.lower()):
            got = known.get(w)
            if got is None:
                if len(known) > self.limit:
                    known.clear()
                got = known[w] = tuple(self.places[f] for f in word_features(w, self.s) if f in self.places)
            if got:
                found.update(got)
        return sorted(found)


@dataclass
class Model:
    places: dict[str, int]
    weights: np.ndarray
    bias: float
    settings: Settings

    def sentence_scores(self, text: str, reader: Sentences) -> list[float]:
        """A sentence without any feature scores 0, so that length alone never makes a text toxic."""
        return [1 / (1 + np.exp(-(self.bias + self.weights[found].sum()))) if (found := reader.of(text[a:b])) else 0.0 for a, b in sentences(text)]


def noisy_or(scores: list[float]) -> float:
    return float(min(1.0, max(0.0, 1 - np.exp(np.sum(np.log1p(-np.minimum(scores, 1 - 1e-12)))))))


def _features(rows: DataFrame, s: Settings) -> dict[str, int]:
    """Features of which most documents are toxic, by the strongest z-score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update({f for w in set(WORD.findall((text or "").lower())) for f in word_features(w, s)})
            both = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[1][f] for f in both], pa.int64()), pa.array([counts[0][f] for f in both], pa.int64())], ["feature", "bad", "good"])

    bad, all_rows = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not bad or bad == all_rows:
        return {}
    base = bad / all_rows
    counts = rows.select("text", "toxic").mapInArrow(run, "feature string, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = F.col("bad") + F.col("good")
    z = (F.col("bad") - base * n) / F.sqrt(n * base * (1 - base) + 1)
    best = counts.filter(n >= s.min_docs).withColumn("z", z).filter((F.col("z") > 3.5) & (2 * F.col("bad") >= n)).orderBy(F.desc("z"), "feature").limit(s.features)
    return {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}  # at most s.features


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on labelled documents that aren't held out; at most ``settings.sample`` of them.

    A document's probability is 1 - prod(1 - p) over its sentences. Full-batch Adam on the log loss. Where ids repeat,
    rows are taken by the hash of their id, then of their text, up to the same bound.
    """
    s = settings
    chosen = (
        labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out("doc_id", 3, 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most s.sample rows are sent
    places = _features(rows, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Sentences(places, s)
        for batch in batches:
            found = [[h for a, b in sentences(text or "") if (h := reader.of((text or "")[a:b]))] for text in batch.column("text").to_pylist()]
            columns = [*map(batch.column, ("h", "doc_id", "t", "toxic")), pa.array(found, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "t", "toxic", "found"])

    keyed = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), "toxic", "text")
    bags = keyed.mapInArrow(run, "h bigint, doc_id bigint, t bigint, toxic int, found array<array<int>>")
    bags = bags.orderBy("h", "doc_id", "t", "found").limit(s.sample).select("toxic", "found").toArrow()  # at most s.sample rows
    return Model(places, *_solve(bags.column("toxic").to_numpy(), bags.column("found").to_pylist(), len(places), s), s)


class Loss:
    """Mean log loss of the noisy-or, and its slope; a sentence is a row of a sparse matrix, a document a run of rows."""

    def __init__(self, toxic: np.ndarray, found: list, n: int, l2: float):
        self.n, self.l2, self.y = n, l2, np.asarray(toxic, dtype=float)
        lists = [f for doc in found for f in doc]
        self.owner = np.repeat(np.arange(len(found)), [len(doc) for doc in found])
        self.rows = np.repeat(np.arange(len(lists)), [len(f) for f in lists]).astype(np.int64)
        self.cols = np.fromiter((x for f in lists for x in f), dtype=np.int64, count=len(self.rows))
        self.sentences = len(lists)

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """Loss, and its slope by each weight and, last, by the bias."""
        logit = bias + np.bincount(self.rows, weights=w[self.cols], minlength=self.sentences)
        hit = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clear = np.bincount(self.owner, weights=np.log1p(-np.minimum(hit, 1 - 1e-12)), minlength=len(self.y))  # ln prod(1-p)
        p = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-9)
        # d loss / d clear: p = 1 - exp(clear); d clear / d logit = -p of the sentence
        slope = np.where(self.y > 0, np.exp(clear) / p, -1.0)
        by_sentence = -slope[self.owner] * hit
        grad = np.bincount(self.cols, weights=by_sentence[self.rows], minlength=self.n)[: self.n] / len(self.y) + self.l2 * w
        loss = -np.mean(np.where(self.y > 0, np.log(p), clear)) + self.l2 * float(w @ w) / 2
        return float(loss), np.append(grad, by_sentence.sum() / len(self.y))


def _solve(toxic: np.ndarray, found: list, n: int, s: Settings) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or log loss."""
    kept = np.array([bool(f) for f in found], dtype=bool)  # a text without any feature scores 0, whatever the weights
    toxic, found = toxic[kept], [f for f in found if f]
    if not len(toxic):
        return np.zeros(n), -6.0
    loss = Loss(toxic, found, n, s.l2)
    w, bias = np.zeros(n), -3.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, s.steps + 1):
        _, g = loss(w, bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def scores(model: Model):
    """Arrow function text -> struct(score, worst_score, worst_start, worst_end): the noisy-or and the worst sentence's place."""

    @F.arrow_udf("struct<score:double, worst_score:double, worst_start:int, worst_end:int, n_sentences:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Sentences(model.places, model.settings)
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                text = text or ""
                each = model.sentence_scores(text, reader)
                k = int(np.argmax(each))
                rows.append((noisy_or(each), float(each[k]), *sentences(text)[k], len(each)))
            types = [pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=["score", "worst_score", "worst_start", "worst_end", "n_sentences"])

    return run.asNondeterministic()


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence, for every row of ``docs`` (doc_id, text).

    Null and empty texts are one empty sentence and score 0. Documents whose label is missing or neither 0 nor 1,
    or whose id is null, are scored but not learned from; with no labels at all every score is 0. Repeated rows are
    scored each; a document labelled twice counts as toxic if one label says so. Of sentences with the same score
    the first is the worst. Very long texts are read whole, a sentence at a time. Other columns are ignored; an
    empty table gives no rows.

    Scale: fitting reads a bounded sample of labelled rows (Settings.sample); scoring is one pass
    without a shuffle, and the broadcast model has at most Settings.features weights.
    """
    model = fit(docs, labels, settings)
    done = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), scores(model)(F.col("text")).alias("s"))
    return done.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.worst_score", "s.worst_start", "s.worst_end", "s.n_sentences")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, columns as they were, whatever their names.

    Null and empty texts score 0 and stay; repeated rows stay or go together; no rows give none.
    """
    model = fit(docs, labels, settings)
    rows = docs.select(F.struct("*").alias("_row"), scores(model)(F.col("text")).alias("_s"))
    return rows.filter(F.col("_s.score") < threshold).select("_row.*")
