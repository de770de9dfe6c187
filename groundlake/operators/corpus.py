"""Corpus preparation: duplicates, structure, sections, chunks and their checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import mean, rounded

FIRST_SECTION = "Introduction / Overview"
# What a chunk may end after, best first; abbreviations, and what follows the dot of an address.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
ABBREVIATIONS = ("rs.", "dr.", "prof.", "mr.", "mrs.", "ms.", "i.e.", "e.g.", "vs.", "etc.", "no.", "dept.", "govt.", "ltd.", "pvt.", "inc.", "corp.", "univ.", "vol.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "oct.", "nov.", "dec.", "approx.", "est.", "min.", "max.")
ADDRESS_PARTS = ("in/", "in ", "gov", "com", "org", "edu", "ac.in", "co.in", "html", "php")
SENTENCE_MARKS = ".?!।"
LIST_MARK = r"\n(?:[•\-\*]|\d+[\.)])\s*"
CHUNK_SIZE, CHUNK_OVERLAP, TINY = 600, 100, 30


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """JB5: doc_id, content_hash and duplicate_of: the smallest id with the same content, null for that one.

    The smallest id comes from a partial aggregation; the join back splits where one content is hot.
    """
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id")).alias("duplicate_of"))


def blocks(docs: DataFrame, numbered_lines: bool = True) -> DataFrame:
    """JB6: paragraphs in order, with the heading that holds for each (WN7); ``numbered_lines`` is False for Markdown, whose headings have # signs."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "part"))
    parts = parts.withColumn("text", tx.strip(F.col("part"))).filter("text <> ''")
    found = tx.heading(F.col("text"), numbered_lines)
    order = Window.partitionBy("doc_id").orderBy("at")
    parts = parts.withColumn("heading_level", found["level"]).withColumn("own_title", found["title"])
    return parts.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("block_no"),
        F.when(F.col("heading_level").isNotNull(), "heading").otherwise("paragraph").alias("block_type"),
        "text",
        "heading_level",
        F.coalesce(F.last("own_title", ignorenulls=True).over(order), F.lit(FIRST_SECTION)).alias("section_title"),
    )


def _merge(groups: DataFrame, keep: Column) -> DataFrame:
    """Join each group that isn't kept to the one before that is; the first of a document always is."""
    order = Window.partitionBy("doc_id").orderBy("group_no")
    numbered = groups.withColumn("nth", F.row_number().over(order)).withColumn("kept", (F.col("nth") == 1) | keep)
    island = F.sum(F.col("kept").cast("int")).over(order)
    return (
        numbered.withColumn("island", island)
        .groupBy("doc_id", "island")
        .agg(
            F.min("group_no").alias("group_no"),
            F.min_by("section_title", "group_no").alias("section_title"),
            F.min_by("heading_level", "group_no").alias("heading_level"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        )
        .drop("island")
    )


def section_groups(blocks_: DataFrame, short: int = 40, tiny: int = 30) -> DataFrame:
    """JB7, WN8: runs of blocks with one section; short ones below the top level, then tiny ones, join the run before."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    changed = F.coalesce((F.col("section_title") != F.lag("section_title").over(order)).cast("int"), F.lit(1))
    runs = blocks_.withColumn("changed", changed).withColumn("group_no", F.sum("changed").over(order))
    level = F.coalesce(F.min_by("heading_level", "block_no"), F.lit(1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")
    groups = runs.groupBy("doc_id", "group_no").agg(F.min("section_title").alias("section_title"), level.alias("heading_level"), joined.alias("text"))
    once = _merge(groups, ~((F.length("text") < short) & (F.col("heading_level") > 1)))
    final = _merge(once, F.length("text") >= tiny)
    return final.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no")) - 1).alias("section_no"), "section_title", "heading_level", "text")


def ends_sentence(text: str, at: int) -> bool:
    """Whether the mark at ``at`` ends a sentence: not inside a number, nor an abbreviation's dot, nor one of an address."""
    if _DIGIT.match(text[at - 1 : at]) and _DIGIT.match(text[at + 1 : at + 2]):
        return False
    if text[at] != ".":
        return True
    word = _BLANK.split(text[max(0, at - 10) : at + 1])[-1].lower().strip(" \t\n()[]{}")
    return word not in ABBREVIATIONS and not text[at + 1 : at + 10].lower().startswith(ADDRESS_PARTS)


def _cut(text: str, start: int, size: int) -> int:
    """End of a chunk that isn't the last: after the best separator whose last place lies past a third of it, else at the full size."""
    least, full = start + max(1, size // 3), start + size
    for mark in SEPARATORS:
        at = text.rfind(mark, least, full)
        if at >= 0 and (mark != ". " or ends_sentence(text, at)):
            return at + len(mark)
    return full


_LIST_MARK, _ORPHAN, _BLANK, _DIGIT = re.compile(LIST_MARK.removesuffix(r"\s*"), re.ASCII), re.compile(tx.as_in_sql(tx.ORPHAN_START), re.ASCII), re.compile(f"[{tx.BLANKS}]+"), re.compile("[0-9]")
_SENTENCE = re.compile(f"[{SENTENCE_MARKS}](?=([ \t\n]*))")


def _begins(text: str, low: int, end: int) -> Iterator[tuple[int, bool]]:
    """Where the next chunk may begin, best first; and whether a small letter may stand there: in the last ``end - low`` places of a chunk, after
    the last paragraph, at the last list mark, after the last sentence, after the last line, after any white space."""
    paragraph = text.rfind("\n\n", low, end) + 2
    if low < paragraph < end:
        yield paragraph, True
    back = text[low:end]
    for mark in list(_LIST_MARK.finditer(back))[-1:]:
        yield low + mark.start() + 1, True
    sentences = [low + m.end(1) for m in _SENTENCE.finditer(back) if m.end(1) < len(back) and ends_sentence(text, low + m.start())]
    yield from ((at, True) for at in sentences[-1:])
    line = text.rfind("\n", low, end) + 1
    if low < line < end:
        yield line, False
    yield from ((low + m.start() + 1, True) for m in _BLANK.finditer(back))


def _restart(text: str, start: int, end: int, overlap: int) -> int:
    """Start of the next chunk: the best place in the last ``overlap`` ones of this chunk that doesn't begin inside a sentence, else its end."""
    if not overlap:
        return end
    found = end
    for at, small in _begins(text, max(start, end - overlap), end):
        rest = text[at:end].strip(tx.BLANKS)
        if rest and not _ORPHAN.match(rest) and (small or unicodedata.category(rest[0]) != "Ll"):
            found = at
            break
    if found <= start:
        found = start + max(1, end - start - overlap)
    return min(found, end)


def split_chunks(text: str, size: int, overlap: int, tiny: int = TINY) -> list[tuple[str, int, int]]:
    """UF2: (text, start, end) of chunks of at most ``size`` characters that cover ``text``; the next one begins up to ``overlap`` places before
    an end. A chunk equal to the one before is left out; a tiny one joins the one before, after an empty line, if both fit."""
    if not text.strip(tx.BLANKS):
        return []
    cuts, start = [], 0
    while start + size < len(text):
        end = _cut(text, start, size)
        cuts.append((start, end))
        start = _restart(text, start, end, overlap)
    cuts.append((start, len(text)))
    out: list[tuple[str, int, int]] = []
    last = None
    for a, z in cuts:
        part = text[a:z]
        if part == last or not part:
            continue
        last = part
        if out and len(part) < tiny and len(out[-1][0]) + len(part) + 2 <= size:
            out[-1] = (f"{out[-1][0]}\n\n{part}", out[-1][1], z)
        else:
            out.append((part, a, z))
    return out


def chunks(sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """JB8, WN9: chunks of each section, numbered through the document, with ids ``doc:p1:cN``.

    Each cut depends on the one before, so sections are cut in Arrow batches; rows stay where they are.
    """

    @F.arrow_udf("array<struct<text:string, start:int, end:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"text": t, "start": a, "end": b} for t, a, b in split_chunks(x or "", size, overlap)] for x in texts.to_pylist()], kind)

    rows = sections.select("doc_id", "section_no", "section_title", "heading_level", F.posexplode(cut("text")).alias("nth", "c"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "nth")) - 1
    return rows.withColumn("chunk_index", index).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":p1:c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", F.lit(1).alias("page_number"), "section_no", "section_title", "heading_level", "chunk_index",
        F.col("c.text").alias("text_content"), F.length("c.text").alias("text_length"), F.col("c.start").alias("source_start_offset"), F.col("c.end").alias("source_end_offset"),
    )


def chunk_faults(chunks_: DataFrame, size: int) -> DataFrame:
    """JB9, WN10: a row for each chunk with its first fault, null for a good one."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    twice = F.count("*").over(Window.partitionBy("chunk_id")) > 1
    fault = (
        F.when(~F.col("chunk_id").rlike(r"^.+:p\d+:c\d+$"), "bad id").when(twice, "duplicate id").when(F.coalesce(tx.strip(F.col("text_content")), F.lit("")) == "", "empty")
        .when(F.col("text_length") != F.length("text_content"), "wrong length").when(F.col("text_length") > size, "too long").when(F.col("page_number") < 1, "bad page")
        .when((F.col("source_start_offset") < 0) | (F.col("source_end_offset") <= F.col("source_start_offset")), "bad offsets").when(F.col("chunk_index") != F.row_number().over(order) - 1, "index gap")
    )
    return chunks_.select("chunk_id", "doc_id", "chunk_index", fault.alias("fault"), tx.is_orphan_start(F.col("text_content")).alias("orphan_start"))


def chunk_report(chunks_: DataFrame) -> DataFrame:
    """JB10, AG28: chunk counts and lengths by document."""
    return chunks_.groupBy("doc_id").agg(F.count("*").alias("chunks"), rounded(mean("text_length"), 2).alias("avg_length"), F.min("text_length").alias("min_length"), F.max("text_length").alias("max_length"), F.sum("text_length").alias("characters"))


def corpus_chunk_report(chunks_: DataFrame, sources: DataFrame) -> DataFrame:
    """JB10, AG28: one row for the corpus: documents, chunks, characters of either, mean length; ``sources``: doc_id, text."""
    none = F.lit(None).cast("int")
    both = sources.select(F.length(F.coalesce("text", F.lit(""))).alias("source"), none.alias("chunk")).unionByName(chunks_.select(none.alias("source"), F.col("text_length").alias("chunk")))
    return both.agg(
        F.count("source").alias("documents"), F.count("chunk").alias("chunks"), F.coalesce(F.sum("source"), F.lit(0)).alias("source_characters"), F.coalesce(F.sum("chunk"), F.lit(0)).alias("chunk_characters"),
        F.coalesce(rounded(mean("chunk"), 2), F.lit(0.0)).alias("avg_length"),
    )


def source_faults(chunks_: DataFrame, sources: DataFrame) -> DataFrame:
    """JB9: (doc_id, fault): texts without chunks, and texts whose first, middle or last word of over two letters stands in none of them.

    Each chunk meets the three words of its document, so that no document is put together again; ``sources``: doc_id, text.
    """
    telling = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), 0), lambda w: F.length(w) > 2)
    docs = sources.filter(tx.strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", telling.alias("w"))
    at = lambda name, i: F.struct(F.lit(name).alias("place"), F.get("w", i).alias("word"))
    wanted = docs.select("doc_id", F.inline(F.array(at("first", F.lit(0)), at("middle", F.floor(F.size("w") / 2).cast("int")), at("last", F.size("w") - 1))))
    held = chunks_.select("doc_id", F.lower("text_content").alias("held"))
    met = wanted.join(held, "doc_id", "left").groupBy("doc_id", "place", "word").agg(F.coalesce(F.bool_or(F.contains("held", "word")), F.lit(False)).alias("found"), F.count("held").alias("chunks"))
    fault = F.when(F.col("chunks") == 0, "no chunks").when(F.col("word").isNotNull() & ~F.col("found"), F.concat("place", F.lit(" word lost")))
    return met.select("doc_id", fault.alias("fault")).filter("fault is not null").distinct()


def coverage(docs: DataFrame) -> DataFrame:
    """AG34."""
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("categories"), F.countDistinct("lang").alias("languages"))


# What a manifest must say of a document, and what it may say.
MANIFEST_FIELDS = ("document_id", "title", "category", "language", "file_path", "source_type", "checksum_sha256", "is_active")
CATEGORIES = ("academic_regulations", "examination_guidelines", "attendance", "scholarships", "hostel", "placements")
CORPUS_LANGUAGES = ("en", "hi", "kn", "te")
EXTENSIONS = (".txt", ".pdf", ".docx")


def corpus_faults(manifest: DataFrame, files: DataFrame, categories: tuple[str, ...] = CATEGORIES, languages: tuple[str, ...] = CORPUS_LANGUAGES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """JB32: (document_id, fault) for a manifest with MANIFEST_FIELDS against files (document_id, text).

    A row without a field is judged no further, but counts among rows of its id; one without a file not by what the file would hold.
    """
    hashed = files.select("document_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("found_hash"), *[c.alias(n) for n, c in tx.pii_flags(F.coalesce("text", F.lit(""))).items()], F.lit(True).alias("exists"))
    ids = manifest.groupBy("document_id").agg(F.count("*").alias("same_id"))
    sums = manifest.groupBy("checksum_sha256").agg(F.count("*").alias("same_sum"))
    rows = manifest.join(hashed, "document_id", "left").join(ids, "document_id", "left").join(sums, "checksum_sha256", "left")
    missing = reduce(lambda a, b: a | b, [F.coalesce(F.col(f).cast("string"), F.lit("")) == "" for f in MANIFEST_FIELDS])
    extension = F.lower(F.regexp_extract("file_path", r"[^/.](\.[^/.]*)$", 1))
    faults = F.array(
        F.when(F.col("same_id") > 1, "duplicate id"), F.when(~F.col("category").isin(*categories), "unknown category"), F.when(~F.col("language").isin(*languages), "unknown language"), F.when(~extension.isin(*extensions), "unsupported extension"),
        F.when(F.col("exists").isNull(), "missing file"), F.when(F.col("found_hash") != F.col("checksum_sha256"), "wrong checksum"), F.when(F.col("same_sum") > 1, "duplicate content"), F.when(F.col("has_id_number") | F.col("has_private_mail"), "personal data"),
    )
    return rows.select("document_id", F.explode(F.when(missing, F.array(F.lit("missing field"))).otherwise(F.array_compact(faults))).alias("fault"))
