"""Spelling variants: words one edit apart, found by a trie of letter-group counts that is cut over many tasks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

SHORTEST = 7
GROUPS = 16  # letters fall into groups by their code point; a level of the trie for each
HELD = 200_000
FRAGMENT = 5_000  # words a fragment of the trie holds, more or less
FRAGMENTS = 16_384
DRAWN = 32  # words drawn for each fragment, to place its borders
PAIRS = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)  # greedy: a run as a whole; shorter runs make no word
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: int | None, text: str, planted: int = 31) -> Counter:
    """Words of a text and how often they stand in it; in every ``planted``-th kind of run, by its hash, a letter is left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % planted == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; a task sends on its counts when it holds ``HELD`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                counts.update(words_of(doc_id, text.as_py() or ""))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Letters of each group in each word: a row of GROUPS numbers."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    cells = np.repeat(np.arange(len(words)) * GROUPS, lengths) + np.frombuffer(b"".join(words), dtype=np.uint8) % GROUPS
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _order(vectors: np.ndarray) -> np.ndarray:
    """Vectors as byte strings that sort as they do."""
    return np.ascontiguousarray(vectors.astype(">u4")).view(f"S{4 * GROUPS}").ravel()  # numpy drops zeros at the end, which keeps the order


class Fragments:
    """Borders of the fragments: each holds the vectors from its border up to the next, which are subtrees side by side."""

    def __init__(self, drawn: np.ndarray, fragments: int):
        found = np.unique(_order(drawn)) if len(drawn) else np.zeros(0, dtype=f"S{4 * GROUPS}")
        step = max(1, -(-len(found) // fragments))
        self.borders = found[step::step]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, _order(vectors), side="right")

    def reached(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, fragment), each once: fragments that hold places of the search for a vector.

        The search goes down level by level for all vectors at once; a branch all of which lies in one fragment ends there.
        """
        rows, state, paths = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int8), vectors.astype(np.int64)
        out = []
        for level in range(GROUPS + 1):
            low, high = paths.copy(), paths.copy()
            low[:, level:], high[:, level:] = 0, (1 << 32) - 1
            first, last = self.of(low), self.of(high)
            done = (first == last) | (level == GROUPS)
            out.append(np.stack([rows[done], first[done]], axis=1))
            rows, state, paths = rows[~done], state[~done], paths[~done]
            if not len(rows):
                break
            rows, state, paths = _steps(rows, state, paths, level)
        found = np.unique(np.concatenate(out), axis=0)
        return found[:, 0], found[:, 1]


def _steps(rows: np.ndarray, state: np.ndarray, paths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level down: the vector's own count (every state), one letter fewer (0 to 1), one more after that (1 to 2)."""
    fewer, more = (state == 0) & (paths[:, level] > 0), state == 1
    less, plus = paths[fewer], paths[more]
    less[:, level] -= 1
    plus[:, level] += 1
    return np.concatenate([rows, rows[fewer], rows[more]]), np.concatenate([state, state[fewer] + 1, state[more] + 1]), np.concatenate([paths, less, plus])


class Trie:
    """Distinct vectors of a fragment as sorted arrays: a node's children lie by (node, count)."""

    def __init__(self, vectors: np.ndarray):
        self.width = int(vectors.max(initial=0)) + 2
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node = np.zeros(len(vectors), dtype=np.int64)
        for level in range(GROUPS):
            keys, node = np.unique(node * self.width + vectors[:, level], return_inverse=True)
            self.levels.append((keys, node))
        self.leaf = np.empty(len(vectors), dtype=np.int64)
        self.leaf[node] = np.arange(len(vectors))

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): leaves that a vector becomes by at most one letter fewer in a group and then one more in a later one.

        The other way round is found from the other end, so each pair of different vectors comes once.
        """
        rows, state, node = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int8), np.zeros(len(vectors), dtype=np.int64)
        for level, (keys, _) in enumerate(self.levels):
            count = vectors[rows, level]
            fewer, more = (state == 0) & (count > 0), state == 1
            rows = np.concatenate([rows, rows[fewer], rows[more]])
            state = np.concatenate([state, state[fewer] + 1, state[more] + 1])
            count = np.concatenate([count, count[fewer] - 1, count[more] + 1])
            node = np.concatenate([node, node[fewer], node[more]])
            wanted = node * self.width + count
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            live = (keys[at] == wanted) & (count < self.width)
            rows, state, node = rows[live], state[live], at[live]
        return rows, self.leaf[node]


class Letters:
    """Words as bytes side by side, to compare many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
        self.text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        # Halves for a pair whose longer word has this length (0), or one letter more (1): one of them is left whole by one edit.
        self.front = [np.array([hash(w[: (len(w) - 1 + k) // 2]) for w in words], dtype=np.int64) for k in (0, 1)]
        self.back = [np.array([hash(w[len(w) - (len(w) - 1 + k) // 2 :]) for w in words], dtype=np.int64) for k in (0, 1)]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] differ by exactly one letter inserted, deleted or replaced; a is as long as b or one longer."""
        shorter = (self.length[a] > self.length[b]).astype(np.int64)
        halves = lambda h: h[0][a] == np.where(shorter, h[1][b], h[0][b])
        out = halves(self.front) | halves(self.back)
        for k in np.unique(self.length[a[out]]).tolist():
            picked = np.flatnonzero(out & (self.length[a] == k))
            for lo in range(0, len(picked), max(1, (1 << 22) // k)):
                part = picked[lo : lo + max(1, (1 << 22) // k)]
                out[part] = self._verified(a[part], b[part], k)
        return out

    def _verified(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        short = self.length[b] < k
        at = np.arange(k)
        left = self.text[self.start[a][:, None] + at]
        last = self.start[b][:, None] + at
        ahead = left == self.text[np.minimum(last, len(self.text) - 1)]
        ahead[short, k - 1] = False
        behind = left == self.text[np.maximum(last - short[:, None], 0)]
        behind[short, 0] = False
        prefix = np.where(ahead.all(axis=1), k, ahead.argmin(axis=1))
        suffix = np.where(behind.all(axis=1), k, behind[:, ::-1].argmin(axis=1))
        return (prefix + suffix >= k - 1) & (short | (prefix < k))


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] places, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _crossed(ours: np.ndarray, theirs: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two long lists of words that share a half: met by its hash, so that lists of words far apart cost their length only."""
    shorter = int(letters.length[ours[0]] > letters.length[theirs[0]])
    out = []
    for half in (letters.front, letters.back):
        keys = half[shorter][theirs]
        order = np.argsort(keys, kind="stable")
        lo, hi = (np.searchsorted(keys[order], half[0][ours], side=s) for s in ("left", "right"))
        out.append(np.stack([np.repeat(ours, hi - lo), theirs[order[_runs(lo, hi - lo)]]]))
    a, b = np.unique(np.concatenate(out, axis=1), axis=1)
    return a, b


def links(words: list[bytes], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of places in ``words`` that are one edit apart, b one of the fragment's own words, each pair once.

    Pairs of one vector come from the fragment that owns it.
    """
    vectors = letter_counts(words)
    keys = _order(vectors)
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    mine = np.unique(group[own])
    if not len(mine):
        return
    leaf_words = np.flatnonzero(own)[np.argsort(group[own], kind="stable")]
    begin, end = (np.searchsorted(group[leaf_words], mine, side=s) for s in ("left", "right"))
    trie, letters = Trie(vectors[first[mine]]), Letters(words)
    by_group = np.argsort(group, kind="stable")
    at, size = np.searchsorted(group[by_group], np.arange(len(first))), np.bincount(group)
    for lo in range(0, len(first), 4096):
        searched = np.arange(lo, min(lo + 4096, len(first)))
        row, leaf = trie.search(vectors[first[searched]])
        row = searched[row]
        many = size[row] * (end - begin)[leaf]
        for i in np.flatnonzero(many > PAIRS).tolist():
            a, b = _crossed(by_group[at[row[i]] : at[row[i]] + size[row[i]]], leaf_words[begin[leaf[i]] : end[leaf[i]]], letters)
            for k in range(0, len(a), PAIRS):
                yield from _kept(a[k : k + PAIRS], b[k : k + PAIRS], group, letters)
        few = np.flatnonzero(many <= PAIRS)
        row, leaf, many = row[few], leaf[few], many[few]
        part = np.cumsum(many) // PAIRS
        for p in np.unique(part).tolist():
            r, t = row[part == p], leaf[part == p]
            width = (end - begin)[t]
            a = np.repeat(by_group[_runs(at[r], size[r])], np.repeat(width, size[r]))
            b = leaf_words[_runs(np.repeat(begin[t], size[r]), np.repeat(width, size[r]))]
            yield from _kept(a, b, group, letters)


def _kept(a: np.ndarray, b: np.ndarray, group: np.ndarray, letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    once = (group[a] != group[b]) | (a > b)
    a, b = a[once], b[once]
    near = letters.near(a, b)
    yield a[near], b[near]


NEAR = "word string, near bigint, best_n bigint, best string"


def _fragment(table: pa.Table) -> pa.Table:
    """For each word of a fragment or of its visitors with a link found here: its links and the near word of largest n."""
    names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    words = [w.encode("latin-1") for w in names]  # letters up to ÿ, whose bytes sort as their code points do
    by_fame = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[by_fame] = np.arange(len(words))
    near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words), dtype=np.int64)
    for a, b in links(words, table.column("own").to_numpy()):
        for x, y in ((a, b), (b, a)):
            near += np.bincount(x, minlength=len(words))
            np.minimum.at(best, x, rank[y])
    some = np.flatnonzero(near)
    to = by_fame[best[some]]
    columns = [pa.array([names[i] for i in some.tolist()], pa.string()), pa.array(near[some]), pa.array(n[to]), pa.array([names[i] for i in to.tolist()], pa.string())]
    return pa.Table.from_arrays(columns, ["word", "near", "best_n", "best"])


def _dealt(words: DataFrame, fragments: Fragments) -> DataFrame:
    """(fragment, word, n, own): each word at the fragment that owns it and at those that its search reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                vectors = letter_counts([w.encode("latin-1") for w in part.column("word").to_pylist()])
                row, fragment = fragments.reached(vectors)
                yield pa.RecordBatch.from_arrays([pa.array(fragment.astype(np.int32)), part.column("word").take(pa.array(row)), part.column("n").take(pa.array(row)), pa.array(fragments.of(vectors)[row] == fragment)], ["fragment", "word", "n", "own"])

    return words.select("word", "n").mapInArrow(run, "fragment int, word string, n bigint, own boolean")


def near_words(words: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """(word, n_near, best, best_n) for each of the distinct ``words`` (word, n) that has a word one edit away.

    A word's search visits the fragments of the trie in which its branches lie; fragments hold about ``fragment``
    words each. Their borders come from at most 524,288 drawn words: they decide how evenly work is dealt, not what is found.
    """
    total = words.count()
    parts = max(1, min(FRAGMENTS, total // fragment))
    drawn = words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(max(1, total // (DRAWN * parts)))) == 0).limit(DRAWN * FRAGMENTS).toArrow() if parts > 1 else None
    fragments = Fragments(letter_counts([w.encode("latin-1") for w in drawn.column("word").to_pylist()]) if drawn else np.zeros((0, GROUPS)), parts)
    dealt = _dealt(words.repartition(max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 100_000)), fragments)
    found = dealt.repartition(max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), "fragment").groupBy("fragment").applyInArrow(_fragment, NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.k")).alias("best_n"))


def variants(docs: DataFrame, times: int = 10, fragment: int = FRAGMENT) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of at least 7 letters found at least twice in ``docs`` (doc_id, text).

    Words are runs of A-Z, a-z and À to ÿ, with A-Z lower-cased; in one kind of run of 31 in a document, by its hash, one letter
    is left out. A word's near words are one inserted, deleted or replaced letter away; its form is the near word of largest n
    (ties: the smallest) if that n is ``times`` its own at least; root is the last of its forms' forms.

    Null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows count again; other columns are
    ignored; no rows give none. Very long texts are read whole, very long words compared whole.

    Scale: texts are read once and not shuffled, only counts of words are. Words lie in a trie by the counts of their letter groups,
    cut into fragments of bounded size over as many tasks as the words need; a search goes to the few fragments it can end in. Words of
    one vector lie together, and long lists of them meet by a shared half, not all with all. Roots take
    a step for each doubling of the chain, and n grows ``times`` along it.
    """
    with scratch(docs.sparkSession, "spelling") as keep:
        words = keep(word_counts(docs).filter("n > 1"), "words")
        near = near_words(words, fragment)
        has_form = F.col("best_n") >= times * F.col("n")
        formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
        formed = keep(formed, "formed")
        roots, step = keep(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
        while True:
            nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = roots.join(nexts, "root", "left")
            if moved.filter("next is not null").isEmpty():
                break
            step += 1
            roots = keep(moved.select("word", F.coalesce("next", "root").alias("root")), f"roots-{step}")
        out = formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "variants")
