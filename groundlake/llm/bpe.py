"""Byte-level BPE over a table of distinct words, and decoding through a join of ids with pieces."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

LONGEST = 64


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): one row per id of the vocabulary; as large as the vocabulary file, whatever the data."""
    found = tokens.byte_pieces(path)
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in found], pa.int32()), "piece": pa.array([p for _, p in found], pa.binary())}))


def common_words(docs: DataFrame, rows: int, held: int = 100_000) -> DataFrame:
    """(word): distinct words of all texts, the ``rows`` commonest if there are more; words over 64 characters are left out.

    A task sends on its counts when it holds ``held`` words, without those it has met once: which words
    are in the table is a matter of speed alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sent = Counter(), False

        def out():
            often = {w: n for w, n in counts.items() if (n > 1 or not sent) and len(w) <= LONGEST}
            return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(tokens.byte_level_words(text or ""))
                if len(counts) > held:
                    sent = True
                    yield out()
                    counts.clear()
        yield out()

    counts = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(rows).select("word")


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """(word, ids): each distinct word is encoded once."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = tokens.load(path)
        for batch in batches:
            yield pa.array(tokens.encode_all(tokenizer, list(map(tokens.spelled, batch.to_pylist()))), pa.list_(pa.int32()))

    return words.select("word", encode.asNondeterministic()("word").alias("ids"))


def decode(ids: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, ids, decoded): the bytes of the ``ids`` column's pieces in order, by a join of ids with pieces; ``key`` names a row."""
    placed = ids.select(key, "ids", F.posexplode_outer("ids").alias("at", "id"))
    found = placed.join(F.broadcast(vocabulary), "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("piece", F.lit(bytearray())).alias("piece"))))
    return found.groupBy(key).agg(F.any_value("ids").alias("ids"), F.aggregate(ordered, F.lit(bytearray()), lambda text, x: F.concat(text, x["piece"])).alias("decoded"))


def encode_documents(docs: DataFrame, path: str, table_words: int = 100_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_same for every row of ``docs`` (doc_id, text).

    Texts are split into words with the white space before them; a table of the distinct words of all texts is
    made in Spark, each word in it encoded once and decoded by joining its ids with the vocabulary's
    pieces. The table has ``table_words`` rows at most, so it can be sent to all tasks, where ids and
    pieces are set in by position. Words beyond the table are encoded in the tasks, once for a batch of
    texts at most, and decoded from the same pieces. Both equal encoding and decoding the whole text at
    once, since no token reaches across a cut. The digests are SHA-256, in lower-case hex, of the decimal
    ids joined by commas and of the decoded text in UTF-8.

    Null texts count as empty: no ids, digests of nothing. Repeated and null ids keep one row each.
    Other columns are ignored; an empty table gives no rows.

    Scale: texts are read twice and never shuffled; only counts of words are. What is broadcast is bounded by
    ``table_words`` (of at most 64 characters) and by the vocabulary.
    """
    spark = docs.sparkSession
    table = decode(word_ids(common_words(docs, table_words), path), "word", pieces(spark, path)).toArrow()  # at most table_words rows
    fixed = {w: (",".join(map(str, ids)), len(ids), b) for w, ids, b in zip(table.column("word").to_pylist(), table.column("ids").to_pylist(), table.column("decoded").to_pylist())}
    sent = spark.sparkContext.broadcast(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, piece = tokens.load(path), dict(tokens.byte_pieces(path))

        def make(words: list[str]) -> list[tuple]:
            ids = tokens.encode_all(tokenizer, list(map(tokens.spelled, words)))
            return [(",".join(map(str, x)), len(x), b"".join(map(piece.__getitem__, x))) for x in ids]

        values = tokens.WordCache(make, sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, texts = [], [t or "" for t in part.column("text").to_pylist()]
                for text, found in zip(texts, values(list(map(tokens.byte_level_words, texts)))):
                    ids, n, held = zip(*found) if text else ((), (), ())
                    out = b"".join(held).decode(errors="replace").encode()
                    rows.append((sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(out).hexdigest(), out == text.encode()))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_same"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_same boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
