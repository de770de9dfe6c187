"""Benchmark decontamination by the q-gram lemma: counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_input, open_output, shared_dir

Q = 8  # bytes of a q-gram: one 64-bit word
STRIDE = 8  # diagonals between bands; a band is twice as wide
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
PIECE = 1 << 20

_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """Lower case; letters and digits; one blank between words."""
    return b" ".join((text or "").lower().encode().translate(_WORDS).split())


def banded(pattern: bytes, text: bytes, first: int, last: int, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of all of ``pattern`` with a part of ``text``, on diagonals ``first``..``last`` only.

    The part may begin and end anywhere in the band; None if it takes more than ``budget`` edits.
    """
    width, n = last - first + 1, len(text)
    places = np.arange(width)
    letters = np.frombuffer(text, dtype=np.uint8)
    big = len(pattern) + budget + 1
    row = np.where((first + places >= 0) & (first + places <= n), 0, big)
    for i, c in enumerate(pattern):
        at = first + places + i  # text position before this letter, on each diagonal
        inside = (at >= 0) & (at < n)
        same = np.full(width, 1)
        same[inside] = letters[at[inside]] != c
        step = np.where(inside, row + same, big)  # match or replace: same diagonal
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # a letter of the pattern is missing in the text
        step = np.minimum.accumulate(step - places) + places  # letters of the text that the pattern lacks
        row = np.where((at + 1 >= 0) & (at + 1 <= n), step, big)
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), first + k + len(pattern)


def _budget(size: int, edits: float) -> int:
    """Edits allowed in a segment; under 16 bytes none, as the lemma needs a q-gram that is left whole."""
    budget = int(edits * size) if size >= 2 * Q else 0
    if budget > min(STRIDE, (size - Q) // Q):
        raise ValueError(f"{budget} edits in {size} bytes: the lemma holds for {(size - Q) // Q}, a band for {STRIDE}")
    return budget


class Patterns:
    """Segments of the benchmark's items and the index of the items' q-grams.

    Segments are cuts of ``segment`` bytes side by side, and windows of four fifths of that which start every
    tenth of it; either kind has one more that ends with the item.
    """

    def __init__(self, items: list[tuple[int, str]], segment: int, edits: float):
        self.segments: list[tuple[int, int, bytes, int, int, bool]] = []  # item by its place in ``items``, offset, bytes, budget, threshold, a cut
        self.short: list[tuple[int, bytes]] = []
        window, step = max(Q, segment * 4 // 5), max(1, segment // 10)
        bodies, self.ranges = [], []  # for each item of the index: its bytes; its first and last segment
        self.names = [item for item, _ in items]
        for item, text in enumerate(text for _, text in items):
            body = normal(text)
            if 0 < len(body) < Q:
                self.short.append((item, b" " + body + b" "))
            elif body:
                n = len(self.segments)
                for size, by in ((segment, segment), (window, step)):
                    if size == window and len(body) <= size < segment:
                        continue  # the cut is the whole item
                    for at in sorted({*range(0, max(1, len(body) - size + 1), by), max(0, len(body) - size)}):
                        part = body[at : at + size]
                        budget = _budget(len(part), edits)
                        self.segments.append((item, at, part, budget, len(part) - Q + 1 - Q * budget, size == segment))
                bodies.append(body)
                self.ranges.append((n, len(self.segments)))
        grams = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, dtype=np.uint8), Q) for p in bodies]
        codes = np.concatenate([np.ascontiguousarray(g).view("<u8")[:, 0] for g in grams]) if grams else np.zeros(0, dtype="<u8")
        order = np.argsort(codes, kind="stable")
        self.owner = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)])[order] if grams else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, dtype=np.int64)
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self._slot(self.codes)] = True
        self.longest = max((len(s[2]) + s[3] for s in self.segments), default=0)
        self.reach = max(map(len, bodies), default=0)
        self.needed = np.array([s[4] for s in self.segments])
        self.from_, self.to = (np.array([s[1] + k * (len(s[2]) - Q + 1) for s in self.segments]) for k in (0, 1))  # places of q-grams
        self.few = np.array([self.needed[a:b].min() for a, b in self.ranges])
        self.least = int(self.few.min()) if len(self.few) else 1

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * MULTIPLY) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, body: bytes) -> list[tuple[int, int, int, int, bool]]:
        """(item, start, end, edits, a cut) of segments found in ``body``, places in bytes."""
        n = len(body) - Q + 1
        if n <= 0 or not len(self.codes):
            return []
        codes = np.ndarray(n, dtype="<u8", buffer=body, strides=(1,))
        near = self.table[self._slot(codes)]
        # A region holds at least self.least shared q-grams in self.longest places: other places can't take part.
        hits = np.flatnonzero(near)
        need = self.least
        if len(hits) < need:
            return []
        if need > 1:
            tight = hits[need - 1 :] - hits[: len(hits) - need + 1] <= self.longest
            marks = np.zeros(len(hits) + 1, dtype=np.int64)
            starts = np.flatnonzero(tight)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + need, -1)
            hits = hits[np.cumsum(marks[:-1]) > 0]
        if not len(hits):
            return []
        known = np.searchsorted(self.codes, codes[hits])
        known[known == len(self.codes)] = 0
        real = self.codes[known] == codes[hits]
        hits, known = hits[real], known[real]
        many = self.count[known]
        at = np.repeat(hits, many)
        index = np.repeat(self.first[known] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(at))
        owner, place = self.owner[index], self.place[index]
        band = (at - place + self.reach + STRIDE) // STRIDE  # never negative
        bands = (len(body) + 2 * self.reach) // STRIDE + 4
        keys, place = np.concatenate([owner * bands + band, owner * bands + band - 1]), np.concatenate([place, place])
        order = np.argsort(keys, kind="stable")
        keys, firsts, counts = np.unique(keys[order], return_index=True, return_counts=True)
        place = place[order]
        kept = np.flatnonzero(counts >= self.few[keys // bands])
        cuts, windows = [], []
        for g in kept.tolist():
            a, z = self.ranges[keys[g] // bands]
            places = np.sort(place[firsts[g] : firsts[g] + counts[g]])
            shared = np.searchsorted(places, self.to[a:z]) - np.searchsorted(places, self.from_[a:z])
            for s in (a + np.flatnonzero(shared >= self.needed[a:z])).tolist():
                (cuts if self.segments[s][5] else windows).append((s, int(keys[g] % bands)))
        out: list[tuple[int, int, int, int, bool]] = []
        spans: dict[int, tuple[int, int]] = {}
        later = []

        def add(item: int, start: int, end: int, edits: int, cut: bool) -> None:
            out.append((item, start, end, edits, cut))
            a, b = spans.get(item, (start, end))
            spans[item] = min(a, start), max(b, end)

        for s, b in cuts + windows:
            item, offset, part, budget, _, cut = self.segments[s]
            low = b * STRIDE - self.reach - STRIDE + offset - budget
            high = low + 2 * STRIDE - 1 + 2 * budget
            lo, hi = max(0, low), min(len(body), high + len(part) + budget + 1)
            exact = body.find(part, lo, hi)
            if exact >= 0:
                add(item, exact, exact + len(part), 0, cut)
            elif budget and not cut:
                later.append((item, part, low, high, lo, hi, budget))
            elif budget and (got := banded(part, body[lo:hi], low - lo, high - lo, budget)):
                add(item, max(0, lo + got[1] - len(part)), lo + got[1], got[0], cut)
        for item, part, low, high, lo, hi, budget in later:  # windows with edits, unless they lie inside the item's span
            a, b = spans.get(item, (hi, lo))
            if (lo < a or hi > b) and (got := banded(part, body[lo:hi], low - lo, high - lo, budget)):
                add(item, max(0, lo + got[1] - len(part)), lo + got[1], got[0], False)
        return out

    def of(self, body: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, segments): one row per item found; the span covers its segments, edits are the fewest of one, segments the cuts found."""
        best: dict[int, list] = {}
        overlap = 2 * self.longest + 2 * STRIDE + Q
        for lo in range(0, max(1, len(body)), PIECE):
            part = body[lo : lo + PIECE + overlap]
            for item, a, b, edits, cut in self.find(part):
                best.setdefault(item, []).append((lo + a, lo + b, edits, cut))
        padded = b" " + body + b" " if self.short else b""
        for item, word in self.short:
            if (at := padded.find(word)) >= 0:
                best.setdefault(item, []).append((at, at + len(word) - 2, 0, True))
        return [(self.names[item], min(x[0] for x in f), max(x[1] for x in f), min(x[2] for x in f), len({x[0] for x in f if x[3]})) for item, f in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Write the benchmark as files of bounded size in the shared folder; their paths are all that comes to the driver."""
    folder = shared_dir(benchmark.sparkSession, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, paths, held, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> None:
            paths.append(f"{folder}/block-{part:06d}-{len(paths):06d}.arrow")
            stream, commit = open_output(paths[-1])
            with pa.ipc.new_stream(stream, held[0].schema) as out:
                for batch in held:
                    out.write_batch(batch)
            commit()

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                held.append(batch.slice(lo, 64))
                size += held[-1].nbytes
                if size >= block_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    rows = benchmark.select("item_id", "text").filter("text is not null")
    return [r[0] for r in rows.coalesce(8).mapInArrow(run, "path string").orderBy("path").collect()]  # a path for each block


_KEPT: dict[tuple, Patterns] = {}


def _patterns(path: str, segment: int, edits: float) -> Patterns:
    """The patterns of a block; a worker keeps those of the last block it has used."""
    if (path, segment, edits) not in _KEPT:
        _KEPT.clear()
        with open_input(path) as file:
            table = pa.ipc.open_stream(file).read_all()
        _KEPT[path, segment, edits] = Patterns(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist())), segment, edits)
    return _KEPT[path, segment, edits]


def _finder(paths: list[str], segment: int, edits: float):
    kind = "array<struct<item_id:bigint, start:bigint, end:bigint, edits:int, segments:int>>"
    out = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("segments", pa.int32())]))
    names = ("item_id", "start", "end", "edits", "segments")

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        bodies = list(map(normal, texts.to_pylist()))
        found: list[list] = [[] for _ in bodies]
        for path in paths:
            patterns = _patterns(path, segment, edits)
            for rows, body in zip(found, bodies):
                rows += patterns.of(body)
        return pa.array([[dict(zip(names, x)) for x in rows] for rows in found], out)

    return run.asNondeterministic()


def leaks(docs: DataFrame, benchmark: DataFrame, segment: int = 100, edits: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, start, end, edits, segments: a row for each benchmark item of which a document holds a passage.

    Items (normal text: lower case, letters and digits) are cut into segments of ``segment`` bytes; windows of
    four fifths of that start every tenth of it; each kind has a last one that ends with the item; shorter
    items are one segment. So any verbatim passage of nine tenths of ``segment`` (90 bytes, some 15 words)
    holds a whole window, wherever it begins; shorter ones are found where they hold a whole segment only.
    A segment is found where it aligns with at most ``edits`` of its length in edits, rounded down; items of under
    16 bytes must occur verbatim, those of under 8 as whole words. A ``segment`` or ``edits`` for which the lemma
    doesn't hold is an error. Regions are kept if a diagonal band shares at least m - q + 1 - q*k q-grams with a segment of m
    bytes and k edits, then aligned within the band, so no segment is lost; windows with edits that lie inside the item's span
    aren't aligned, as they can't widen it. ``segments`` counts cuts, 0 for a passage that only windows have
    found; ``edits`` are the fewest of an aligned segment. Places are bytes of the document's normal text.
    Empty and null items match nothing, nor do empty and null texts. Very long texts are read in pieces that
    overlap. Items that repeat are reported each, as are repeated rows; other columns are ignored; no rows give none.

    Scale: the text is read once and isn't shuffled. The benchmark lies in the shared folder in blocks of
    ``block_bytes``; a task goes through them for each batch of texts and holds one at a time.
    """
    found = _finder(_blocks(benchmark, block_bytes), segment, edits)
    return docs.select("doc_id", F.explode(found(F.col("text"))).alias("x")).select("doc_id", "x.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, segment: int = 100, edits: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found by ``leaks``, columns as they were, whatever their names.

    Null and empty texts stay, as does every row where the benchmark is empty; repeated rows stay or go together.
    """
    found = _finder(_blocks(benchmark, block_bytes), segment, edits)
    return docs.select(F.struct("*").alias("row"), found(F.col("text")).alias("found")).filter(F.size("found") == 0).select("row.*")
