"""Quality rules: base counts, and Jensen-Shannon distance of a document's histograms to its language's."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

SYMBOLS = re.compile(rb"[#*$%&|<>]")
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
#: Classes of characters: lower-case ASCII letters, upper-case, digits, blanks, line ends, sentence marks, other ASCII, non-ASCII.
CLASSES = 8
_CLASS = bytes(0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in b" \t" else 4 if b in b"\n\v\f\r" else 5 if b in b".,;:!?'\"()-" else 6 if b < 128 else 7 for b in range(256))
_TRIM = b".,;:!?'\"()-"


def repeat_words(words: list) -> int:
    """Words that lie in a 5-word window found twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    chars = len(b"".join(words).decode())
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text.translate(_CLASS), dtype=np.uint8), minlength=CLASSES)[:CLASSES]


def common_words(text: bytes) -> list[bytes]:
    return [w.strip(_TRIM) for w in text.lower().split()]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1 (square root of the divergence in bits)."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    half = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))


def references(docs: DataFrame, top: int = 100, limit: int = 200_000) -> dict:
    """lang -> (class histogram, {word: place}, word histogram) from all texts of the language.

    The word histogram has the ``top`` commonest words and, last, all others. Counts are summed in a task
    up to ``limit`` words, then in Spark; what comes back is ``top`` + CLASSES numbers a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out():
            rows = [(lang, None, i, int(n)) for lang, (classes, words) in held.items() for i, n in enumerate([*classes, words.total()])]
            rows += [(lang, w.decode(), None, n) for lang, (_, words) in held.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "word", "class", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                if lang not in held:
                    held[lang] = [np.zeros(CLASSES, dtype=np.int64), Counter()]
                held[lang][0] += char_classes(text)
                held[lang][1].update(common_words(text))
            if sum(len(w) for _, w in held.values()) > limit:
                yield from out()
                held = {}
        if held:
            yield from out()

    sums = docs.select("lang", "text").mapInArrow(run, "lang string, word string, class int, n bigint").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.desc("n"), "word", "class")
    ranked = sums.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    found: dict = {}
    for r in ranked.collect():
        classes, words = found.setdefault(r["lang"], (np.zeros(CLASSES + 1), {}))  # the last: all words
        if r["word"] is None:
            classes[r["class"]] = r["n"]
        else:
            words[r["word"].encode()] = r["n"]
    out = {}
    for lang, (classes, words) in found.items():
        order = sorted(words, key=lambda w: (-words[w], w))
        counts = [words[w] for w in order]
        out[lang] = (classes[:CLASSES], {w: i for i, w in enumerate(order)}, np.array([*counts, max(0, classes[CLASSES] - sum(counts))], dtype=float))
    return out


def verdicts(known: dict, max_class: float, max_words: float, min_chars: int, min_words: int, min_reference: int):
    """Arrow function (lang, text) -> base counts, distances and verdict."""
    kind = f"struct<{', '.join(c.replace(' ', ':') for c in COLUMNS.split(', '))}, class_distance:double, word_distance:double, base_failed:boolean, kept:boolean>"

    @F.arrow_udf(kind)
    def run(langs: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for lang, text in zip(langs.to_pylist(), text_bytes(texts)):
            n, chars, symbols, lines, repeats = base_counts(text)
            by_class = by_word = None
            classes, places, words = known.get(lang, (None, None, None))
            if words is not None and words.sum() >= min_reference:
                if len(text) >= min_chars:
                    by_class = distance(char_classes(text).astype(float), classes)
                if n >= min_words:
                    own, other = np.zeros(len(words)), len(places)
                    for w, k in Counter(common_words(text)).items():
                        own[places.get(w, other)] += k
                    by_word = distance(own, words)
            failed = n < 10 or 100 * repeats > 20 * n
            good = (by_class or 0.0) <= max_class and (by_word or 0.0) <= max_words
            rows.append((n, chars, symbols, lines, repeats, by_class, by_word, failed, not failed and good))
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["class_distance", "word_distance", "base_failed", "kept"]
        types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=names)

    return run.asNondeterministic()


def rate(docs: DataFrame, max_class: float = 0.30, max_words: float = 0.52, min_chars: int = 200, min_words: int = 50, min_reference: int = 1000) -> DataFrame:
    """``docs`` (lang, text and any others) with a struct column ``quality``: base counts, distances, base_failed, kept.

    A column of that name is replaced; all others stay as they were.
    A document fails if it fails the base rules, or if one of its histograms - classes of characters, the
    language's 100 commonest words and all others - lies further from its language's than the limit.
    Histograms of texts under ``min_chars`` bytes or ``min_words`` words say too little and aren't judged
    (distance null); nor are languages of under ``min_reference`` words. A null language is one of its own.
    Null texts count as empty, which fail the base rules. Repeated rows are judged each; very long texts are judged
    whole. Of words equally common the smaller takes the last place among the common ones. No rows give none.

    Scale: one pass that sums histograms per language in the task and in Spark, one that judges; the text isn't shuffled.
    """
    known = references(docs)
    judged = verdicts(known, max_class, max_words, min_chars, min_words, min_reference)
    return docs.withColumn("quality", judged(F.col("lang"), F.col("text")))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, columns as they were, whatever their names; null and empty texts go."""
    rows = rate(docs.select(F.struct("*").alias("_row"), "lang", "text"), **limits)
    return rows.filter("quality.kept").select("_row.*")
