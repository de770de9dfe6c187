"""WARC archives: written as one gzip stream a file, normalised to a member a record with an offset index, read by offset."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, kept, open_input, open_output, shared_dir, text_bytes

CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RAW = "file string, ordinal bigint, page_id bigint, payload_bytes bigint, payload_digest string"
INDEX = "file string, at bigint, length bigint, page_id bigint, record_type string, payload_digest string"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, ordinal: int, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A WARC/1.1 record of an HTTP response; a revisit has the HTTP header alone, which states the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id) if page_id is not None else f'<urn:record:{ordinal}>'}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~ ").strip())
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def parse(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines)


def http_parts(block: bytes) -> tuple[int, bytes]:
    """Stated length of the payload, and the payload that is there."""
    head, _, payload = block.partition(CRLF * 2)
    return int(next(x for x in head.split(CRLF) if x.lower().startswith(b"content-length:")).split(b":")[1]), payload


class Stream:
    """Records of one gzip stream, or of many members; memory holds one record and a chunk."""

    def __init__(self, file, chunk: int = 1 << 18):
        self.file, self.chunk, self.inflate, self.held, self.rest = file, chunk, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.file.read(self.chunk)
        if not data:
            return False
        self.held += self.inflate.decompress(data)
        self.rest = b""
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        return True

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            seen = 0
            while (end := self.held.find(CRLF * 2, seen)) < 0:
                seen = max(0, len(self.held) - 3)
                if not self._more():
                    if self.held.strip():
                        raise EOFError("the archive ends inside a header")
                    return
            head = parse(self._take(end + 4)[:-4])
            block = self._take(int(head["Content-Length"]))
            self._take(4)
            yield head, block


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = 16 << 20, level: int = 1) -> DataFrame:
    """Write ``pages`` as response records, one gzip stream a file of about ``roll_bytes``; returns what each holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, stream, rows, size = TaskContext.get().partitionId(), 0, None, [], 0

        def close() -> pa.RecordBatch:
            stream.write(deflate.flush())
            commit()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "ordinal", "page_id", "payload_bytes", "payload_digest"])

        for batch in batches:
            for page_id, url, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), text_bytes(batch.column("html"))):
                if stream is None:
                    uri = f"{folder}/raw/part-{part:06d}-{roll:05d}.warc.gz"
                    (stream, commit), deflate, rows, size = open_output(uri), zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                digest = payload_digest(payload)
                data = record(page_id, len(rows), url, payload, digest)
                stream.write(deflate.compress(data))
                rows.append((uri, len(rows), page_id, len(payload), digest))
                size += len(data)
                if size >= roll_bytes:
                    yield close()
                    stream, roll = None, roll + 1
        if stream is not None:
            yield close()

    return pages.select("page_id", "url", "html").mapInArrow(run, RAW)


def revisits(held: DataFrame) -> DataFrame:
    """(file, ordinal, refers_to): refers_to is the largest page_id with an equal payload if that isn't the page itself."""
    last = held.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return held.join(last, ["payload_digest", "payload_bytes"]).select("file", "ordinal", other.alias("refers_to"))


def normalise(decided: DataFrame, level: int = 6) -> DataFrame:
    """Inflate each file of ``decided`` once and write every record as a member of its own; returns the index.

    A record that refers to another becomes a revisit. Beside each new archive stands its index as text:
    offset, length, page, type and digest of each member.
    """

    def run(table: pa.Table) -> pa.Table:
        uri = table.column("file")[0].as_py()
        refers = dict(zip(table.column("ordinal").to_pylist(), table.column("refers_to").to_pylist()))
        target = uri.replace("/raw/", "/members/")
        stream, commit = open_output(target)
        rows, at = [], 0
        with open_input(uri) as file:
            for ordinal, (head, block) in enumerate(Stream(file)):
                urn, to = head["WARC-Record-ID"], refers[ordinal]
                page_id = int(urn[10:-1]) if urn.startswith("<urn:page:") else None
                digest = head["WARC-Payload-Digest"].partition(":")[2]
                if to is None:
                    data = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]).encode() + CRLF * 2 + block + CRLF * 2
                else:
                    url = head.get("WARC-Target-URI")
                    data = record(page_id, ordinal, url, http_parts(block)[1], digest, to, True)
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = deflate.compress(data) + deflate.flush()
                stream.write(member)
                rows.append((target, at, len(member), page_id, "response" if to is None else "revisit", digest))
                at += len(member)
        commit()
        side, commit = open_output(f"{target}.idx")
        side.write("".join(f"{r[1]} {r[2]} {'-' if r[3] is None else r[3]} {r[4]} {r[5]}\n" for r in rows).encode())
        commit()
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "at", "length", "page_id", "record_type", "payload_digest"])

    files = decided.select("file").distinct().count()
    parts = max(2 * files, int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return decided.repartition(parts, "file").groupBy("file").applyInArrow(run, INDEX)


def read_members(index: DataFrame) -> DataFrame:
    """Read each indexed member by its offset; fields come from the records, digests are checked where the payload is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            rows = []
            for uri, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length"))):
                if uri != name:
                    if file is not None:
                        file.close()
                    name, file = uri, open_input(uri)
                file.seek(at)
                data = zlib.decompress(file.read(length), 31)
                head, _, rest = data.partition(CRLF * 2)
                fields = parse(head)
                size, payload = http_parts(rest[: int(fields["Content-Length"])])
                digest = fields["WARC-Payload-Digest"].partition(":")[2]
                kind, urn, to = fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
                if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"{uri} at {at}: the payload isn't the one recorded")
                rows.append((int(urn[10:-1]) if urn.startswith("<urn:page:") else None, size, digest, kind, int(to[10:-1]) if to else None, fields.get("WARC-Target-URI")))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if file is not None:
            file.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file", "at", "length").repartition(parts, "file").sortWithinPartitions("file", "at").mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html), normalise the archives and read them back; a row a page.

    Of records with equal payloads (SHA-1 and length) that with the largest page_id is the response and
    the others revisit it. Null html is an empty payload, equal to other empty ones. Rows that repeat the
    largest page_id are all responses. A page without an id revisits one that has an id; if none has,
    all are responses. A null url has no target line. Other columns are ignored; no rows, no files.

    Scale: html is never shuffled: it goes to disk as it is read, and the decision which records are
    revisits is made on digests, by a partial maximum and one join that splits where a digest is hot.
    A task of the normaliser holds one record of a file of about 16 MB at a time; a very large page is one record.
    Files are dealt to twice as many tasks. The monolithic archives are deleted once their members are written.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    held = kept(write_monolithic(pages, folder), f"{folder}/held")
    index = kept(normalise(revisits(held)), f"{folder}/index")
    deleted(spark, f"{folder}/raw")
    deleted(spark, f"{folder}/held")
    return read_members(index)
