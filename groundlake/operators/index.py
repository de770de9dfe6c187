"""Upkeep of the searchable index and its registry, as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import valid_vector

# What the metadata of an index record must name, and the types of all that it may name.
REQUIRED_KEYS = ("chunk_id", "doc_id", "file_hash_sha256", "category", "language", "script", "page_number", "chunk_index")
METADATA = (
    "chunk_id string, doc_id string, file_hash_sha256 string, filename string, category string, language string, script string, page_number int, section_title string, heading_level int, chunk_index int, text_length int, source_start_offset int, "
    "source_end_offset int, source_unit_index int, parser_name string, parser_version string, version string, extraction_notes string, embedding_model_name string, embedding_dimension int, embedding_device string, embedding_normalized boolean, vector_index_version int"
)
DEFAULTS = {"category": "general", "section_title": "Introduction / Overview", "heading_level": 1, "extraction_notes": "[]"}


def upsert_actions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """JN9: (chunk_id, action): insert, update where the content hash differs, skip where it doesn't."""
    old = existing.select("chunk_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "insert").when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "skip").otherwise("update")
    return incoming.join(old, "chunk_id", "left").select("chunk_id", action.alias("action"))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: rows of ``existing`` that aren't replaced, and all of ``incoming``."""
    return existing.join(incoming.select("chunk_id"), "chunk_id", "left_anti").unionByName(incoming.select(*existing.columns))


def stale_and_missing(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """JN10, ST2."""
    stale = existing.select("chunk_id").join(expected.select("chunk_id"), "chunk_id", "left_anti").withColumn("state", F.lit("stale"))
    return stale.unionByName(expected.select("chunk_id").join(existing.select("chunk_id"), "chunk_id", "left_anti").withColumn("state", F.lit("missing")))


def sync(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JB29: the next snapshot without stale rows, and the report (AG36)."""
    stale = existing.join(incoming.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("remove").alias("action"))
    actions = upsert_actions(existing, incoming).unionByName(stale)
    snapshot = upsert(existing, incoming).join(stale, "chunk_id", "left_anti")
    return snapshot, actions.groupBy("action").agg(F.count("*").alias("chunks"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """AM6: the scalar metadata of chunks by their declared types; notes as JSON; blank or absent values by ``DEFAULTS``, others null."""

    def value(name: str, kind: str) -> Column:
        found = F.col(name) if name in chunks.columns else F.lit(None)
        if name == "extraction_notes" and name in chunks.columns:
            found = F.when(F.size(name) > 0, F.to_json(name))
        found = found.cast(kind)
        if name in DEFAULTS:
            found = F.coalesce(F.when(found != F.lit(0 if kind == "int" else ""), found), F.lit(DEFAULTS[name]))
        return found.alias(name)

    return chunks.select(*[value(*field.split()) for field in METADATA.split(", ")])


def record_faults(index: DataFrame, dimension: int, required: tuple[str, ...] = ()) -> DataFrame:
    """JB30: every row is checked: id, vector, text, and the ``required`` columns (``REQUIRED_KEYS``), which must be there and not null."""
    absent = [F.when(F.col(k).isNull() if k in index.columns else F.lit(True), f"no {k}") for k in required]
    named = F.coalesce(F.contains("chunk_id", F.lit(":")), F.lit(False))
    faults = F.array(F.when(~named, "bad id"), F.when(~valid_vector(F.col("embedding"), dimension), "bad vector"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"), *absent)
    return index.select("chunk_id", F.explode(F.array_compact(faults)).alias("fault"))


def integrity(registry: DataFrame, index: DataFrame) -> DataFrame:
    """JB31, JN11: documents with vectors but no entry, and active entries without vectors."""
    orphan = index.select("doc_id").distinct().join(registry.select("doc_id"), "doc_id", "left_anti").withColumn("state", F.lit("orphan"))
    return orphan.unionByName(registry.filter("is_active").select("doc_id").join(index.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("state", F.lit("not indexed")))


def content_matches(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """JN12: incoming documents whose content stands in the registry under another id."""
    known = registry.groupBy("content_hash").agg(F.min("doc_id").alias("known_id"), F.count("*").alias("known_ids"))
    return incoming.join(known, "content_hash").filter((F.col("known_id") != F.col("doc_id")) | (F.col("known_ids") > 1)).select("doc_id", "known_id")


def delete_documents(table: DataFrame, ids: DataFrame) -> DataFrame:
    """JB33, JN14: the rows that stay; used on registry, jobs and chunks alike."""
    return table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def _owned(chunks: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Chunks that are (``left_semi``) or aren't (``left_anti``) those of the documents, by doc_id or by what stands before the colon of their id."""
    gone = ids.select(F.col("doc_id").cast("string").alias("gone")).distinct()
    own = [F.col("doc_id").cast("string") == F.col("gone"), F.substring_index("chunk_id", ":", 1) == F.col("gone")]
    if how == "left_anti":
        return chunks.join(gone, own[0], how).join(gone, own[1], how)
    return chunks.join(gone, own[0], how).unionByName(chunks.join(gone, own[0], "left_anti").join(gone, own[1], how))


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """JB33: the chunks that stay."""
    return _owned(chunks, ids, "left_anti")


def remaining(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """JB33: (remaining): how many chunks of the documents are there; 0 after they are deleted."""
    return _owned(chunks, ids, "left_semi").agg(F.count("*").alias("remaining"))


def sync_registry(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """JB34: manifest values win; entries that it doesn't name stay; ``action`` says what happened."""
    r, m = registry.alias("r"), manifest.alias("m")
    pick = lambda c: F.coalesce(f"m.{c}", f"r.{c}").alias(c)
    same = F.col("m.title").eqNullSafe(F.col("r.title")) & F.col("m.category").eqNullSafe(F.col("r.category")) & F.col("m.is_active").eqNullSafe(F.col("r.is_active"))
    action = F.when(F.col("r.doc_id").isNull(), "insert").when(F.col("m.doc_id").isNull(), "keep").when(same, "keep").otherwise("update")
    return r.join(m, F.col("r.doc_id") == F.col("m.doc_id"), "full").select(pick("doc_id"), pick("title"), pick("category"), pick("is_active"), action.alias("action"))


def embedding_contract(embedded: DataFrame, dimension: int) -> DataFrame:
    """JB11: one row of counts: vectors, valid ones, unit ones."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = valid_vector(F.col("embedding"), dimension)
    return embedded.agg(F.count("*").alias("vectors"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.abs(norm - 1) < 1e-3)).alias("unit"))
