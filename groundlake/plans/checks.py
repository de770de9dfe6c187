"""Registered queries of records, coverage, evaluation and of what is written and read back."""

from __future__ import annotations

from ..functions.numbers import F
from ..operators import corpus as c
from ..operators import ground as g
from ..operators import index as ix
from ..operators import metrics as m
from ..operators import retrieval as r
from ..sources import documents as sd
from ..sources import events as se
from ..sources.shared import shared_folder
from . import retrieval as rp
from .details import CHOSEN, chosen
from .telemetry import ENV, QUERY, grouped, rnd, sets, sql
from .view import LAKE_SQL, lake

read = rp.read

#: Index records of all documents; some lack a value that they must have.
_RECORD = {
    "chunk_id": "CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE concat('D', CAST(doc_id AS STRING), ':p1:c0') END", "file_hash_sha256": "CASE WHEN doc_id % 10 <> 0 THEN source END", "category": "CASE WHEN doc_id % 11 <> 0 THEN source END",
    "language": "lang", "page_number": "CASE WHEN doc_id % 13 <> 0 THEN 1 END", "chunk_index": "CAST(doc_id % 4 AS INT)",
}


def records(s, d):
    return read(s, d, "documents").selectExpr("doc_id", "text", *[f"{x} AS {k}" for k, x in _RECORD.items()], "array(1.0D, 0.0D) AS embedding")


#: Chunks of all documents: their lines; some lines are lost, and some documents.
_LINE = "CASE WHEN (doc_id % 4 = 0 AND chunk_index = 0) OR (doc_id % 5 = 0 AND chunk_index > 3) THEN '' ELSE text END"


def lossy(s, d):
    return chosen(s, d).filter("doc_id % 7 <> 3").selectExpr("doc_id", f"{_LINE} AS text_content", "length(text) AS text_length")


COVERED = (
    "words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda w: length(w) > 2) AS w FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''), "
    "wanted AS (SELECT doc_id, unnest(['first', 'middle', 'last']) AS place, unnest([w[1], w[1 + len(w) // 2], w[len(w)]]) AS word FROM words), "
    f"held AS (SELECT doc_id, string_agg(lower({_LINE}), ' ') AS held FROM lines WHERE doc_id % 7 <> 3 GROUP BY doc_id)"
)

def preserved(s, d):
    rows = rp.guarded(s, d)
    gold = rows.selectExpr("query_id", "language", "CASE WHEN query_id % 300 < 100 THEN 'https://x.org/a' END AS expected_url", "CASE WHEN query_id % 200 < 100 THEN '33' ELSE '' END AS expected_number")
    return g.preservation(g.guard(rows), gold)


def _share(flag: str, over: str) -> str:
    return f"floor(CAST(count(*) FILTER (WHERE ({over}) AND ({flag})) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE {over})) * 10000 + 0.5) / 10000"


PRESERVED = (
    f"SELECT {_share('contains(answer, expected_url)', 'expected_url IS NOT NULL')} AS url_preservation_rate, {_share('contains(answer, expected_number)', 'length(expected_number) > 0')} AS number_preservation_rate, "
    "{} AS script_purity_rate FROM (SELECT g.query_id, language, answer, CASE WHEN g.query_id % 300 < 100 THEN 'https://x.org/a' END AS expected_url, CASE WHEN g.query_id % 200 < 100 THEN '33' ELSE '' END AS expected_number FROM ({}) g JOIN (SELECT query_id, language FROM ({})) USING (query_id))"
)
_PURE = "NOT CASE language WHEN 'te' THEN regexp_matches(answer, '{0}') WHEN 'kn' THEN regexp_matches(answer, '{1}') ELSE regexp_matches(answer, '{0}') OR regexp_matches(answer, '{1}') END".format(rp.tx.BLOCKS["kannada"], rp.tx.BLOCKS["telugu"])
PRESERVED = PRESERVED.format(_share(_PURE, "language IN ('hi', 'kn', 'te')"), rp.GUARD, rp.GUARDED_ROWS)


def runs(s, d):
    return rp.vector_queries(s, d).selectExpr("query_id", "CAST(query_id % 700 AS DOUBLE) / 4 AS latency_ms", "query_id % 3 AS variants")


RUNS = "runs AS (SELECT vec_id AS query_id, CAST(vec_id % 700 AS DOUBLE) / 4 AS latency_ms, vec_id % 3 AS variants FROM embeddings WHERE vec_id % 100 = 0)"
TITLES = "CASE WHEN document_id = 'DOC-7' THEN ' ' ELSE concat('Title of ', document_id) END"


def titles(s, d):
    """Titles of the documents that queries of the live environment named."""
    return lake(s, d).filter("telemetry_environment = 'live' AND document_id NOT IN ('', 'DOC-3')").select("document_id").distinct().withColumn("title", F.expr(TITLES))


def written_lines(s, d):
    path = shared_folder(s, "events")
    read(s, d, "events").selectExpr("concat('{\"id\": ', CAST(event_id AS STRING), '}', CASE WHEN event_id % 10 = 0 THEN '\\n' ELSE '' END) AS line").write.text(path)
    back = se.read_events_jsonl(s, path, "*.txt")
    return back.groupBy(F.get_json_object("line", "$.id").cast("bigint").alias("event_id")).agg(F.count("*").alias("lines"), F.min("line_number").alias("at"), F.first("source_file").alias("f")).withColumn("numbered", F.col("at") >= 1).select("event_id", "lines", "numbered")


def written_lake(s, d):
    path = shared_folder(s, "lake")
    se.write_lake(lake(s, d), path)
    return se.read_lake(s, path).select("event_id", "telemetry_environment", "date", "hour", "event_type", "language")


def written_by_type(s, d):
    path = shared_folder(s, "types")
    se.write_by_type(lake(s, d).select("event_id", "event_type", "language"), path)
    return s.read.schema("event_id string, language string, event_type string").json(path)


def written_metrics(s, d):
    path = shared_folder(s, "metrics")
    rows = lake(s, d)
    se.write_metrics({k: m.FAMILY[k](rows) for k in ("volume_by_type", "language_distribution", "retrieval")}, path)
    return se.read_metrics_manifest(s, path).select("name", "environment", "rows", "schema_version")


def _manifest(name: str, *keys: str, source: str = "lake") -> str:
    return f"SELECT '{name}' AS name, environment, count(*) AS rows, '1.0' AS schema_version FROM ({grouped('count(*) AS events', source, *keys) if keys else f'SELECT {ENV} FROM lake GROUP BY {sets()}'}) GROUP BY environment"


_FILE = "concat('d', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.exe' WHEN 3 THEN '.md' ELSE '' END)"
_METADATA = {"category": "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END", "heading_level": "CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 4 AS INT) END", "language": "lang", "text_length": "length(text)"}

QUERIES = {
    "ag33_latency_percentiles": (
        lambda s, d: m.latency_percentiles(lake(s, d)),
        sql(f"SELECT {ENV}, " + ", ".join(f"{rnd(f'quantile_cont({k}_latency_ms, {q / 100})', 2)} AS {k}_p{q}_ms" for k in ("retrieval", "total") for q in (50, 95)) + f" FROM q GROUP BY {sets()}"),
    ),
    "am06_chunk_metadata": (
        lambda s, d: ix.chunk_metadata(read(s, d, "documents").selectExpr("CAST(doc_id AS STRING) AS chunk_id", "doc_id", *[f"{x} AS {k}" for k, x in _METADATA.items()], "CASE WHEN doc_id % 2 = 0 THEN array(lang, source) END AS extraction_notes")).select("chunk_id", "doc_id", "category", "heading_level", "section_title", "language", "text_length", "extraction_notes", "filename"),
        f"SELECT chunk_id, doc_id, CASE WHEN COALESCE(category, '') = '' THEN 'general' ELSE category END AS category, CASE WHEN COALESCE(heading_level, 0) = 0 THEN 1 ELSE heading_level END AS heading_level, 'Introduction / Overview' AS section_title, language, text_length, extraction_notes, CAST(NULL AS VARCHAR) AS filename FROM (SELECT CAST(doc_id AS STRING) AS chunk_id, CAST(doc_id AS STRING) AS doc_id, {', '.join(f'{x} AS {k}' for k, x in _METADATA.items())}, CASE WHEN doc_id % 2 = 0 THEN concat('[\"', lang, '\",\"', source, '\"]') ELSE '[]' END AS extraction_notes FROM documents)",
    ),
    "jb30_required_keys": (
        lambda s, d: ix.record_faults(records(s, d), 2, ix.REQUIRED_KEYS),
        f"SELECT chunk_id, unnest(list_filter([CASE WHEN chunk_id = 'x' THEN 'bad id' END, CASE WHEN COALESCE(trim(text), '') = '' THEN 'no text' END, 'no script', {', '.join(f'CASE WHEN {k} IS NULL THEN {chr(39)}no {k}{chr(39)} END' for k in ('file_hash_sha256', 'category', 'language', 'page_number'))}], lambda x: x IS NOT NULL)) AS fault FROM (SELECT text, {', '.join(f'{x} AS {k}' for k, x in _RECORD.items())} FROM documents)",
    ),
    "jb33_delete_chunks": (
        lambda s, d: ix.delete_chunks(records(s, d).withColumn("doc_id", F.concat(F.lit("D"), (F.col("doc_id") * 2).cast("string"))), read(s, d, "documents").filter("lang = 'fr'").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"))).select("chunk_id", "doc_id"),
        f"WITH gone AS (SELECT concat('D', CAST(doc_id AS STRING)) AS g FROM documents WHERE lang = 'fr') SELECT chunk_id, d AS doc_id FROM (SELECT {_RECORD['chunk_id']} AS chunk_id, concat('D', CAST(doc_id * 2 AS STRING)) AS d FROM documents) WHERE d NOT IN (SELECT g FROM gone) AND string_split(chunk_id, ':')[1] NOT IN (SELECT g FROM gone)",
    ),
    "jb33_remaining": (lambda s, d: ix.remaining(records(s, d), read(s, d, "documents").filter("lang = 'fr'")), "SELECT count(*) AS remaining FROM documents WHERE lang = 'fr'"),
    "jb09_source_faults": (
        lambda s, d: c.source_faults(lossy(s, d), read(s, d, "documents")),
        f"WITH {CHOSEN}, {COVERED} SELECT DISTINCT doc_id, CASE WHEN held IS NULL THEN 'no chunks' ELSE concat(place, ' word lost') END AS fault FROM wanted LEFT JOIN held USING (doc_id) WHERE held IS NULL OR NOT contains(held, word)",
    ),
    "jb10_corpus_report": (
        lambda s, d: c.corpus_chunk_report(lossy(s, d), read(s, d, "documents")),
        f"WITH {CHOSEN}, l AS (SELECT length(text) AS n FROM lines WHERE doc_id % 7 <> 3) SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, (SELECT sum(length(text)) FROM documents) AS source_characters, sum(n) AS chunk_characters, floor(CAST(sum(n) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_length FROM l",
    ),
    "ag32_preservation": (preserved, PRESERVED),
    "ag29_quality_and_runs": (
        lambda s, d: r.evaluate(rp.asked_labels(s, d), rp.label_hits(s, d, rp.dense(s, d)), "category", runs=runs(s, d)),
        rp.with_(f"SELECT h.*, avg_latency_ms, avg_variants FROM ({rp.hits('den', 'category')}) h JOIN (SELECT category, floor(avg(latency_ms) * 100 + 0.5) / 100 AS avg_latency_ms, floor(avg(variants) * 100 + 0.5) / 100 AS avg_variants FROM (SELECT DISTINCT query_id, category FROM gold) JOIN runs USING (query_id) GROUP BY category) USING (category)", rp._dense("den"), rp.GOLD, RUNS),
    ),
    "jn01_titles": (
        lambda s, d: m.document_usage(lake(s, d), titles(s, d)).select("environment", "document_id", "title", "query_count"),
        f"WITH {LAKE_SQL}, q AS (SELECT * FROM lake WHERE {QUERY}), known AS (SELECT DISTINCT document_id, {TITLES} AS t FROM lake WHERE telemetry_environment = 'live' AND document_id NOT IN ('', 'DOC-3')) SELECT environment, document_id, CASE WHEN trim(COALESCE(t, '')) <> '' THEN t ELSE concat('Institutional Document (', document_id, ')') END AS title, query_count FROM ({grouped('count(*) AS query_count', chr(40) + 'SELECT * FROM q WHERE document_id <> ' + chr(39) * 2 + chr(41), 'document_id')}) LEFT JOIN known USING (document_id)",
    ),
    "src01_events_jsonl": (written_lines, "SELECT event_id, count(*) AS lines, true AS numbered FROM events GROUP BY event_id"),
    "src03_lake_round_trip": (written_lake, sql("SELECT event_id, telemetry_environment, date, hour, event_type, language FROM lake")),
    "snk02_by_type": (written_by_type, sql("SELECT event_id, event_type, language FROM lake")),
    "snk05_metrics_manifest": (written_metrics, sql(f"{_manifest('volume_by_type', 'event_type')} UNION ALL {_manifest('language_distribution', 'language', source='q')} UNION ALL {_manifest('retrieval')}")),
    "prj14_admitted": (
        lambda s, d: sd.admitted(read(s, d, "documents").selectExpr(f"{_FILE} AS path", "CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 15728641 ELSE octet_length(text) END AS length"), limit=15 << 20),
        f"SELECT * FROM (SELECT {_FILE} AS path, CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 15728641 ELSE strlen(text) END AS length FROM documents) WHERE regexp_matches(path, '(?i)\\.(pdf|txt|md)$') AND length BETWEEN 1 AND 15728640",
    ),
}
