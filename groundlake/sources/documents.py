"""Sources of documents, chunks, manifests and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "document_id string, chunks array<struct<chunk_id:string, doc_id:string, filename:string, category:string, language:string, script:string, page_number:int, section_title:string, heading_level:int, chunk_index:int, text_content:string, text_length:int>>"
PARSED = "doc_id string, filename string, file_type string, page_count int, normalized_text string, detected_language string, detected_script string, pages array<struct<page_number:int, text:string, blocks:array<struct<block_type:string, text:string, heading_level:int, section_title:string>>>>"
MANIFEST = "document_id string, title string, category string, language string, file_path string, version string, file_type string, checksum_sha256 string, is_active boolean"
QUESTIONS = "question_id string, question string, language string, acceptable_answer_points array<string>, source_documents array<struct<document_id:string, page:int>>, category string, answer_available boolean"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC4."""
    files = spark.read.schema(CHUNKS).option("multiLine", True).option("pathGlobFilter", "*_chunks.json").json(path)
    return files.select(F.explode("chunks").alias("c")).select("c.*")


def read_parsed(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SRC5, JN2: parsed documents with what the manifest says of them."""
    files = spark.read.schema(PARSED).option("multiLine", True).option("pathGlobFilter", "*_parsed.json").json(path)
    return files.join(manifest.select(F.col("document_id").alias("doc_id"), "title", "category", "version"), "doc_id", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC7."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (path, text, warnings): UTF-8 without its mark, else Latin-1. Spark reads no row of a file without bytes; a file of the mark alone is EMPTY_FILE."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    body = F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    utf8 = F.is_valid_utf8(body.cast("string"))
    text = F.when(utf8, F.decode(body, "UTF-8")).otherwise(F.decode(body, "ISO-8859-1"))
    warnings = F.array_compact(F.array(F.when(F.octet_length(body) == 0, "EMPTY_FILE"), F.when(marked, "BOM_STRIPPED"), F.when(~utf8, "UTF8_DECODE_FALLBACK")))
    return raw.select("path", text.alias("text"), warnings.alias("warnings"))


def admitted(files: DataFrame, extensions: tuple[str, ...] = ("pdf", "docx", "txt", "md"), limit: int = 15 << 20) -> DataFrame:
    """PRJ14: files (path, length) of a known kind and a size of 1 byte to 15 MiB."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(kind.isin(*extensions) & F.col("length").between(1, limit))
