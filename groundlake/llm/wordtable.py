"""Texts as numbers of their block's words; and what a table of all distinct words says, brought back to the blocks.

A task cuts its rows into blocks of bounded size as it reads them. A block has its distinct words once, and its
texts as numbers of those words, so the text itself never moves. Distinct words meet in one shuffle by word; what is
found of them goes back to the blocks by number. No task needs more than one block and its words, and a word
is met at most once a block, so that no word is a hot key.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 400_000
PACK_TOKENS = 1 << 20

PACKS = "doc_ids array<bigint>, lengths array<int>, places binary"
ROWS = f"block bigint, held_out boolean, {PACKS}, at int, word string, kind int, n bigint"


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def coded(docs: DataFrame, split: Callable[[bytes], list[bytes]], kind: Callable[[bytes], int], block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as rows of two kinds, told apart by ``word`` being null.

    Packs (block, held_out, doc_ids, lengths, places): texts of one side, their words as numbers (zstd, 32 bits each).
    Words (block, at, word, kind, n): number of the word, what ``kind`` says of it, its count in texts that aren't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("held_out", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("at", pa.int32()), ("word", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])
        block, size, n = first, 0, np.zeros(0, dtype=np.int64)
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        open_: dict[bool, tuple[list, list, array]] = {}

        def row_set(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def close(side: bool) -> pa.RecordBatch:
            nonlocal n
            ids, lengths, places = open_.pop(side)
            places = np.frombuffer(places, dtype=np.uint32)
            if not side:
                n = np.bincount(places, minlength=len(words)) + np.pad(n, (0, len(words) - len(n)))
            return row_set(1, block=[block], held_out=[side], doc_ids=[ids], lengths=[lengths], places=[packed(places)])

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal block, size, n
            for side in list(open_):
                yield close(side)
            found, total = list(words), np.pad(n, (0, len(words) - len(n)))
            for lo in range(0, len(found), 1 << 16):
                part = found[lo : lo + (1 << 16)]
                yield row_set(len(part), block=[block] * len(part), at=np.arange(lo, lo + len(part), dtype=np.int32), word=pa.array(part, pa.binary()).cast(pa.string()), kind=list(map(kind, part)), n=total[lo : lo + len(part)])
            words.clear()
            block, size, n = block + 1, 0, np.zeros(0, dtype=np.int64)

        for batch in batches:
            for doc_id, side, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), text_bytes(batch.column("text"))):
                ids, lengths, places = open_.setdefault(side, ([], [], array("I")))
                before = len(places)
                places.extend(map(words.__getitem__, split(text)))
                ids.append(doc_id)
                lengths.append(len(places) - before)
                size += len(text)
                if len(places) >= pack_tokens or len(ids) >= pack_tokens:
                    yield close(side)
                if size >= block_bytes or len(words) >= block_words:
                    yield from end()
        yield from end()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, ROWS)


def _parts(rows: DataFrame) -> int:
    """As many shuffle partitions as blocks, the session's number at least: a task's share doesn't grow with the input."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.filter("at = 0").count())


def counted(rows: DataFrame) -> DataFrame:
    """(block, at, word, kind, c, first): the count ``c`` of each block's words in all blocks; ``first`` in one block of each word's."""
    everywhere = Window.partitionBy("word")
    words = rows.filter("word is not null").select("block", "at", "word", "kind", "n").repartition(_parts(rows), "word")
    return words.select("block", "at", "word", "kind", F.sum("n").over(everywhere).alias("c"), (F.col("block") == F.min("block").over(everywhere)).alias("first"))


def with_words(rows: DataFrame, said: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work(packs, words)`` on each block's packs and on what ``said`` (block, at, ...) says of its words."""
    packs = rows.filter("places is not null").select("block", "held_out", "doc_ids", "lengths", "places")
    parts = _parts(rows)
    return packs.repartition(parts, "block").groupBy("block").cogroup(said.repartition(parts, "block").groupBy("block")).applyInArrow(work, schema)
