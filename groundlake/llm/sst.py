"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

File: blocks, index, filter, footer. A block holds entries in key order, compressed with zstd: shared
prefix length with the key before it, rest of the key, value; lengths are LEB128. The index has the
first key, offset and length of each block. The footer is of fixed size and comes last. A key is a
null flag and the doc_id in big-endian order with its sign bit turned, so that bytes sort as ids do.
A value is the ids, 16 bits each where the vocabulary allows, else 32, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import open_input, open_output, shared_dir

MAGIC = b"GLSSTBL1"
FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")
PROBES = 7
BITS_PER_KEY = 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _leb(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unleb(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries must come in key order; memory holds one block, the index and 8 bytes a key for the filter."""

    def __init__(self, stream, width: int, block_bytes: int = 64 << 10):
        self.stream, self.width, self.block_bytes = stream, width, block_bytes
        self.block, self.first, self.last, self.at = bytearray(), None, b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.n = self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _leb(shared) + _leb(len(key) - shared) + key[shared:] + _leb(len(value)) + value
        self.last = key
        self.n += 1
        self.n_tokens += len(value) // self.width
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.first is not None:
            data = self.pack(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self._write(data)
        self.block, self.first, self.last = bytearray(), None, b""

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def finish(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(_leb(len(k)) + k + _leb(at) + _leb(n) for k, at, n in self.index))
        filter_at = self.at
        bits = max(64, -(-self.n * BITS_PER_KEY // 64) * 64)
        h = np.frombuffer(self.hashes, dtype=np.uint64) if self.hashes else np.zeros(0, dtype=np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        held = np.zeros(bits, dtype=np.uint8)
        for i in range(PROBES):
            held[((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)] = 1
        self._write(np.packbits(held, bitorder="little").tobytes())
        self._write(FOOTER.pack(index_at, filter_at - index_at, filter_at, bits, self.n, self.n_tokens, self.width, MAGIC))


class Reader:
    """Reads footer and index at once, blocks as they are asked for."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        index_at, index_n, self.filter_at, self.bits, self.n, self.n_tokens, self.width, magic = FOOTER.unpack(self._bytes(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        data, at = self._bytes(index_at, index_n), 0
        self.first, self.places = [], []
        while at < index_n:
            n, at = _unleb(data, at)
            self.first.append(data[at : at + n])
            place, at = _unleb(data, at + n)
            length, at = _unleb(data, at)
            self.places.append((place, length))

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data = zstandard.ZstdDecompressor().decompress(self._bytes(*self.places[k]))
        at, key = 0, b""
        while at < len(data):
            shared, at = _unleb(data, at)
            n, at = _unleb(data, at)
            key = key[:shared] + data[at : at + n]
            size, at = _unleb(data, at + n)
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if self.width == 2 else "<u4")

    def get(self, key: bytes) -> bytes | None:
        """The first value of ``key``: Bloom filter, binary search in the index, then at most two blocks."""
        for p in _probes(key, self.bits):
            if not self._bytes(self.filter_at + p // 8, 1)[0] >> (p % 8) & 1:
                return None
        k = bisect_right(self.first, key)
        while k > 0 and self.first[k - 1] == key:
            k -= 1
        for j in range(max(0, k - 1), min(len(self.places), k + 1)):
            for found, value in self.block(j):
                if found == key:
                    return value
        return None


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str, cache_words: int = 800_000) -> DataFrame:
    """Encode and write; returns the manifest (shard, path, n_docs, n_tokens), shards in ascending doc_id order.

    A shard is one range of ids. Rows with equal ids stand in the order of their texts' hashes; equal rows may lie
    in many shards. There are as many shards as partitions read, the session's number at least, so that a shard
    doesn't grow with the input.
    """
    width = 2 if tokens.load(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    code = "H" if width == 2 else "I"
    end = array(code, [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tokens.WordCache:
            tokenizer = tokens.load(path)
            return tokens.WordCache(lambda words: [array(code, ids).tobytes() for ids in tokens.encode_all(tokenizer, words)], limit=cache_words)

        encode = tokens.kept_cache((path, code, cache_words), fresh)
        shard = TaskContext.get().partitionId()
        uri, writer = f"{folder}/shard-{shard:06d}.sst", None
        for batch in batches:
            if writer is None:
                stream, commit = open_output(uri)
                writer = Writer(stream, width)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, words in zip(part.column("doc_id").to_pylist(), encode(list(map(tokens.lone_words, texts)))):
                    writer.add(key_of(doc_id), b"".join(words) + end)
        if writer is not None:
            writer.finish()
            commit()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "n_docs": writer.n, "n_tokens": writer.n_tokens}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    parts = max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "doc_id", "h", F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "shard int, path string, n_docs bigint, n_tokens bigint")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of the shards in ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                with open_input(uri) as file:
                    reader, rows = Reader(file), []
                    for key, value in reader:
                        ids = reader.ids(value)
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    first = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # one row a shard
    starts = manifest.select("path", first.alias("first"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(parts, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_shards(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token shards in the shared folder and read them back.

    Returns doc_id, start (ids of all documents before it in doc_id order), n_tokens (with the end id),
    ids_crc32. Null and empty texts hold the end id only. A null doc_id sorts first. Repeated ids keep
    an entry each, in the order of their texts' hashes. A very long text is one entry. Other columns are ignored; no
    rows give no shards.

    Scale: one range shuffle of the text. A task streams one shard, holding a block of 64 KiB, the
    index and a bounded cache of word ids; a shard that is written again replaces its file as a whole.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-shards")
    shards = write_shards(docs, path, end_id, folder)
    shards.write.parquet(f"{folder}/manifest")
    return read_shards(spark.read.schema(shards.schema).parquet(f"{folder}/manifest"))
