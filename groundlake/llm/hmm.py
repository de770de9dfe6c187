"""Hidden Markov language model: Baum-Welch counts summed in Spark, likelihoods by the scaled forward recursion."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordtable
from .common import held_out, scratch, small_batches, written

LOG10 = math.log(10)


@dataclass(frozen=True)
class Settings:
    """states: latent states. frequent: words with a symbol of their own, by count. classes: symbols of all
    other known words, by their first and last letters. rounds: Baum-Welch passes over all training texts.
    unigram: share of the unigram in every state's emissions. These size the model, not the data it sees."""

    states: int = 6
    frequent: int = 4096
    classes: int = 2048
    rounds: int = 4
    unigram: float = 0.05

    @property
    def end(self) -> int:
        return self.frequent + self.classes

    @property
    def unknown(self) -> int:
        return self.end + 1

    @property
    def symbols(self) -> int:
        return self.end + 2

    @property
    def kind(self) -> str:
        return "<u2" if self.symbols <= 1 << 16 else "<u4"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # A-Z; space, \t-\r


def word_class(word: bytes, s: Settings) -> int:
    return s.frequent + zlib.crc32(word[:2] + b"\0" + word[-3:]) % s.classes


def _batches(lengths: np.ndarray, cells: int = 1 << 19, most: int = 4096) -> Iterator[np.ndarray]:
    """Rows of like length together, longest first, at most ``cells`` padded places unless one row is longer."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(most, cells // max(1, int(lengths[order[at]]))))
        yield order[at : at + n]
        at += n


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by place and row, and how many rows are longer than each place; rows come by falling length."""
    lengths = np.array([len(r) for r in rows])
    padded = np.zeros((int(lengths[0]), len(rows)), dtype=np.int32)
    for j, r in enumerate(rows):
        padded[: len(r), j] = r
    return padded, np.searchsorted(-lengths, -np.arange(len(padded)), side="left")


def likelihoods(rows: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """ln-likelihood of each text by the scaled forward recursion."""
    padded, live = _padded(rows)
    logs, ones, alpha = np.zeros(len(rows)), np.ones(len(start)), None
    for t, m in enumerate(live):
        alpha = (start[None, :] if t == 0 else alpha[:m] @ move) * emit[padded[t, :m]]
        total = alpha @ ones
        alpha /= total[:, None]
        logs[:m] += np.log(total)
    return logs


def _forward(padded: np.ndarray, live: np.ndarray, lo: int, hi: int, before: np.ndarray | None, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, scaled forward vectors and scales of places ``lo`` to ``hi``; ``before`` is the vector of the place before them."""
    n, k = padded.shape[1], len(start)
    ahead = emit[padded[lo:hi]]
    ahead *= (np.arange(n)[None, :] < live[lo:hi, None])[:, :, None]
    alphas, scales, ones = np.zeros((hi - lo, n, k), dtype=np.float32), np.ones((hi - lo, n), dtype=np.float32), np.ones(k, dtype=np.float32)
    for t, m in enumerate(live[lo:hi]):
        now = alphas[t, :m]
        if before is None:
            np.multiply(start[None, :], ahead[0], out=now)
        else:
            np.matmul(before[:m], move, out=now)
            now *= ahead[t, :m]
        np.matmul(now, ones, out=scales[t, :m])
        now /= scales[t, :m, None]
        before = alphas[t]
    return ahead, alphas, scales


def expected_counts(rows: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, span: int = 1 << 17) -> float:
    """Add the expected counts of the texts by scaled forward and backward recursions; returns their ln-likelihood.

    Vectors of ``span`` places are held at once: of longer texts only those at the spans' ends are kept, and the
    others made anew on the way back.
    """
    padded, live = _padded(rows)
    steps, n = padded.shape
    k = len(start)
    start, move, emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)
    spans = [(lo, min(steps, lo + span)) for lo in range(0, steps, span)]
    ends: list[np.ndarray | None] = [None]
    for lo, hi in spans[:-1]:
        ends.append(_forward(padded, live, lo, hi, ends[-1], start, move, emit)[1][-1].copy())
    total, beta, back = 0.0, np.ones((n, k), dtype=np.float32), np.ascontiguousarray(move.T)
    for (lo, hi), before in zip(reversed(spans), reversed(ends)):
        ahead, alphas, scales = _forward(padded, live, lo, hi, before, start, move, emit)
        total += float(np.log(scales, dtype=np.float64).sum())
        gamma = np.zeros((hi - lo, n, k), dtype=np.float32)
        for t in range(hi - lo - 1, -1, -1):
            m = live[lo + t]
            np.multiply(alphas[t, :m], beta[:m], out=gamma[t, :m])
            now = ahead[t, :m]
            now *= beta[:m]
            now /= scales[t, :m, None]
            np.matmul(now, back, out=beta[:m])
        for a in range(0, hi - lo - 1, 1024):  # sums of some places at a time, in double precision over these
            b = min(hi - lo - 1, a + 1024)
            moves += move * (alphas[a:b].reshape(-1, k).T @ ahead[a + 1 : b + 1].reshape(-1, k))
        if before is None:
            starts += gamma[0].sum(axis=0)
        else:
            moves += move * (before.T @ ahead[0])
        used = np.arange(n)[None, :] < live[lo:hi, None]
        symbols, weights = padded[lo:hi][used], gamma[used]
        for s in range(k):
            counts[:, s] += np.bincount(symbols, weights=weights[:, s], minlength=len(counts))
    return total


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def _first(s: Settings, unigram: np.ndarray) -> Model:
    """States start alike but for fixed pseudo-random weights on symbols; they all but stay, so that whole texts choose."""
    draw = np.random.default_rng(7).random((s.symbols, s.states)) + 0.25
    emit = _mixed(unigram[:, None] * draw, s, unigram)
    move = np.full((s.states, s.states), 0.001 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.999 if s.states > 1 else 1.0)
    return Model(np.full(s.states, 1 / s.states), move, emit)


def _mixed(counts: np.ndarray, s: Settings, unigram: np.ndarray) -> np.ndarray:
    """Emissions: the unknown word has the unigram's probability in every state, the rest shares what is left."""
    counts = counts.copy()
    counts[s.unknown] = 0
    known = unigram.copy()
    known[s.unknown] = 0
    total = counts.sum(axis=0)
    share = np.where(total > 0, counts / np.where(total > 0, total, 1), known[:, None] / max(known.sum(), 1e-300))
    out = (1 - s.unigram) * share + s.unigram * (known / max(known.sum(), 1e-300))[:, None]
    out *= 1 - unigram[s.unknown]
    out[s.unknown] = unigram[s.unknown]
    return out


def _encoded(docs: DataFrame, s: Settings, keep: Callable[[DataFrame, str], DataFrame]):
    """Packs of texts as symbols, and the corpus numbers; everything counted over all training texts.

    A pack: held_out, doc_ids, lengths (with the end), known, base, inner (one each a text), symbols. ``keep`` writes a table.
    """
    rows = keep(wordtable.coded(docs.select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")), words_of, lambda w: word_class(w, s)), "coded")
    words = keep(wordtable.counted(rows), "counted")
    each = words.filter("first and c > 0")  # one row a word of the training texts
    n_words, types = each.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = rows.filter("not held_out").agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    total, types = n_words + ends, types + (ends > 0)
    top = [r["word"] for r in each.orderBy(F.desc("c"), "word").limit(s.frequent).select("word").collect()]  # at most s.frequent words
    own = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(top)), "own int, word string"))
    named = words.join(own, "word", "left").select("block", "at", "c", "first", F.when(F.col("c") == 0, s.unknown).otherwise(F.coalesce("own", "kind")).alias("symbol"))
    sizes = named.filter("first and c > 0").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most s.symbols rows
    shares = np.zeros(s.symbols)
    for k, c, v in sizes:
        shares[k] = c + v
    shares[s.end] = ends + (ends > 0)
    shares[s.unknown] = 1
    whole, end_top = math.log10(total + types + 1), math.log10(ends + 1)

    def work(packs: pa.Table, words: pa.Table) -> pa.Table:
        at, c, symbol = (words.column(x).to_numpy() for x in ("at", "c", "symbol"))
        symbols, base, inner, known = np.empty(len(at), dtype=s.kind), np.empty(len(at)), np.empty(len(at)), np.empty(len(at), dtype=np.int64)
        symbols[at], known[at] = symbol, c > 0
        base[at] = np.log10(c + 1.0)
        inner[at] = np.where(c > 0, np.log10((c + 1.0) / np.maximum(shares[symbol], 1)), 0)
        out = []
        for side, ids, lengths, places in zip(*(packs.column(x).to_pylist() for x in ("held_out", "doc_ids", "lengths", "places"))):
            places, edges = wordtable.unpacked(places, "<u4"), np.concatenate([[0], np.cumsum(lengths)])
            sums = [[float(v[places[a:b]].sum()) for a, b in zip(edges, edges[1:])] for v in (base, inner, known)]
            n = np.array(lengths, dtype=np.int64) + 1
            coded = np.insert(symbols[places], edges[1:], s.end)
            out.append((side, ids, n, np.array(sums[2], dtype=np.int64) + (ends > 0), np.array(sums[0]) + end_top - whole * n, np.array(sums[1]), wordtable.packed(coded)))
        kinds = (pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
        names = ("held_out", "doc_ids", "lengths", "known", "base", "inner", "symbols")
        return pa.table({name: pa.array(column, k) for name, column, k in zip(names, list(zip(*out)) or [()] * 7, kinds)})

    schema = "held_out boolean, doc_ids array<bigint>, lengths array<bigint>, known array<bigint>, base array<double>, inner array<double>, symbols binary"
    packs = keep(wordtable.with_words(rows, named.select("block", "at", "c", "symbol"), work, schema), "symbols")
    return packs, shares / (total + types + 1), total


def _texts(lengths: list[int], symbols: bytes, s: Settings) -> list[np.ndarray]:
    return np.split(wordtable.unpacked(symbols, s.kind), np.cumsum(lengths)[:-1]) if lengths else []


def train(packs: DataFrame, unigram: np.ndarray, s: Settings) -> tuple[Model, list[float]]:
    """Baum-Welch over all texts of ``packs``; each pass sums expected counts, a table of symbols x states, in Spark."""
    model, seen = _first(s, unigram), []
    names = [f"k{i}" for i in range(s.states)]
    for _ in range(s.rounds):
        start, move, emit = model.start, model.move, model.emit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, moves, starts, total = np.zeros((s.symbols, s.states)), np.zeros((s.states, s.states)), np.zeros(s.states), 0.0
            for batch in batches:
                for lengths, symbols in zip(batch.column("lengths").to_pylist(), batch.column("symbols").to_pylist()):
                    rows = _texts(lengths, symbols, s)
                    for part in _batches(np.array(lengths)):
                        total += expected_counts([rows[i] for i in part], start, move, emit, counts, moves, starts)
            some = np.flatnonzero(counts.any(axis=1))
            table = np.vstack([counts[some], moves, starts[None, :], np.full((1, s.states), total)])
            keys = np.concatenate([some, -1 - np.arange(s.states), [-1 - s.states, -2 - s.states]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(table[:, i]) for i in range(s.states))], ["symbol", *names])

        sums = packs.select("lengths", "symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])
        counts, moves, starts, total = np.zeros((s.symbols, s.states)), np.zeros((s.states, s.states)), np.zeros(s.states), 0.0
        for row in sums.collect():  # at most symbols + states + 2 rows
            k, values = row[0], np.array(row[1:])
            if k >= 0:
                counts[k] = values
            elif k >= -s.states:
                moves[-1 - k] = values
            elif k == -1 - s.states:
                starts = values
            else:
                total = values[0]
        seen.append(total)
        model = Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), _mixed(counts, s, unigram))
    return model, seen


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    ``score`` is the log10 probability of the whole text and its end under a hidden Markov model trained
    by Baum-Welch on the texts that are not held out. A state emits a symbol, a symbol a word: frequent
    words are symbols of their own; others share a symbol by their first and last letters and are drawn
    from it by add-one counts; the unknown word has the add-one probability of the base in every state.
    So with one state the model equals the base, and what it gains comes from its states. Ties for the last
    place among the frequent words go to the smaller word.

    Null and empty texts are the end token alone. A null doc_id counts as held out. Repeated rows count
    and are scored each. Other columns are ignored. With no rows to learn from, N and V are 0. A very long text
    is one block; its recursions hold the vectors of ``span`` places at a time (``expected_counts``).

    Scale: word counts cover all training texts. The text is read once and never moves: what is shuffled are
    each block's distinct words, once by word and once back, and its texts as compressed numbers. Passes of
    training read texts as symbols and send a table of symbols x states. What is written on the way is deleted.
    """
    s, spark = settings, docs.sparkSession
    with scratch(spark, "hidden-markov") as keep:
        with small_batches(spark, 1000):
            packs, unigram, total = _encoded(docs, s, keep)
        with small_batches(spark, 4):
            model, _ = train(packs.filter("not held_out"), unigram, s)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for p in batch.to_pylist():
                        rows, lengths = _texts(p["lengths"], p["symbols"], s), np.array(p["lengths"])
                        logs = np.zeros(len(rows))
                        for part in _batches(lengths):
                            logs[part] = likelihoods([rows[i] for i in part], model.start, model.move, model.emit)
                        n = len(rows)
                        columns = {"doc_id": pa.array(p["doc_ids"], pa.int64()), "held_out": [p["held_out"]] * n, "n_tokens": lengths, "n_known": pa.array(p["known"], pa.int64()), "train_tokens": [total] * n}
                        yield pa.RecordBatch.from_pydict(columns | {"base_score": pa.array(p["base"], pa.float64()), "score": logs / LOG10 + np.array(p["inner"])})

            schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
            return written(packs.mapInArrow(run, schema), "scores")
