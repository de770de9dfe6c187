"""Registered queries of search, fusion, grounding and evaluation."""

from __future__ import annotations

from pyspark.sql import Window

from ..functions import text as tx
from ..functions.numbers import F, cosine, rounded, unit
from ..operators import ground as g
from ..operators import index as ix
from ..operators import lexical as lx
from ..operators import retrieval as r
from .corpus import TOKENS_SQL
from .ingest import _list


def read(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def chunks(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "lang", F.lit(1).alias("page_number"), F.col("source").alias("section_title"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"))


def asked(s, d):
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(s, d):
    return read(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))


_INDEXES: dict[tuple[str, str], lx.LexicalIndex] = {}


def index(s, d):
    """The stored index of all documents; built once an application."""
    key = s.sparkContext.applicationId, d
    if key not in _INDEXES or not _INDEXES[key].stored():
        _INDEXES[key] = lx.build(chunks(s, d))
    return _INDEXES[key]


def lexical(s, d, k=12):
    return lx.search(index(s, d), asked(s, d), k)


def dense(s, d, k=12):
    return r.dense_search(vector_queries(s, d), vectors(s, d), k)


def lists(s, d):
    """Two ranked lists of documents for every hundredth document: by the vectors of their ids, and by the words of their whole texts."""
    texts = read(s, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return dense(s, d), lx.search(index(s, d), texts, 12).select("query_id", "chunk_id", "lexical_score", "rank")


def _top(score: str, k: int = 12) -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) <= {k}"


def _asked(source: str) -> str:
    return f"SELECT query_id, unnest(CASE WHEN len(list_filter(l, lambda t: t NOT IN ({_list(tx.LEXICAL_STOP_WORDS)}))) > 0 THEN list_filter(l, lambda t: t NOT IN ({_list(tx.LEXICAL_STOP_WORDS)})) ELSE l END) AS term FROM ({source})"


def bm25(source: str) -> str:
    return _BM25.replace("ASKED", _asked(source))


_BM25 = (
    f"tok AS (SELECT doc_id AS chunk_id, {TOKENS_SQL} AS l FROM documents), lens AS (SELECT chunk_id, len(l) AS len FROM tok), post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(l) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    "qt AS (SELECT query_id, term, count(*) AS qtf FROM (ASKED) GROUP BY ALL), size AS (SELECT count(*) AS n, greatest(1.0, avg(len)) AS mean FROM lens), "
    "bm AS (SELECT query_id, chunk_id, floor(sum(qtf * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean)))) * 1000000 + 0.5) / 1000000 AS score FROM qt JOIN df USING (term) JOIN post USING (term) JOIN lens USING (chunk_id) CROSS JOIN size GROUP BY ALL), "
    f"lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM bm WHERE score > 0 QUALIFY {_top('score')})"
)


def _dense(n: str) -> str:
    e = lambda x: f"list_transform({x}.embedding, lambda v: CAST(v AS DOUBLE))"
    return (
        f"{n} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, floor(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), list_cosine_similarity({e('q')}, {e('c')}))) * 10000 + 0.5) / 10000 AS dense_score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) QUALIFY {_top('dense_score')})"
    )


BM25 = bm25(f"SELECT item_id AS query_id, {TOKENS_SQL} AS l FROM benchmark")
LISTS = f"{_dense('den')}, {bm25(f'SELECT doc_id AS query_id, {TOKENS_SQL} AS l FROM documents WHERE doc_id % 100 = 0')}, lx AS (SELECT query_id, chunk_id, floor(score / max(score) OVER (PARTITION BY query_id) * 10000 + 0.5) / 10000 AS lexical_score, rank FROM lex)"
MERGED = "merged AS (SELECT query_id, chunk_id, max(dense_score) AS dense_score, max(lexical_score) AS lexical_score, string_agg(m, ',' ORDER BY m) AS methods FROM (SELECT query_id, chunk_id, dense_score, NULL AS lexical_score, 'dense' AS m FROM den UNION ALL SELECT query_id, chunk_id, NULL, lexical_score, 'lexical' FROM lx) GROUP BY ALL)"
RANKED = "ranked AS (SELECT query_id, chunk_id, rank, 'dense' AS method FROM den UNION ALL SELECT query_id, chunk_id, rank, 'lexical' FROM lx)"
RRF = "rrf AS (SELECT query_id, chunk_id, floor(sum(CAST(1 AS DOUBLE) / (60 + rank)) * 1000000 + 0.5) / 1000000 AS rrf_score FROM ranked GROUP BY ALL)"


def with_(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def context_rows(s, d):
    return r.hydrate(lexical(s, d, 8).select("query_id", "chunk_id", "rank"), chunks(s, d).drop("doc_id"))


BLOCK = r"concat('[Source ', CAST(rank AS STRING), '] d', CAST(chunk_id AS STRING), ' (Page 1', CASE WHEN COALESCE(source, '') <> '' THEN concat(' · ', source) ELSE '' END, E')\n', t)"
PACKED = f"packed AS (SELECT query_id, rank AS source_no, chunk_id, block FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS running, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM (SELECT query_id, rank, chunk_id, {BLOCK} AS block FROM (SELECT lex.*, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM lex JOIN documents ON doc_id = chunk_id WHERE rank <= 8) WHERE t <> '')) WHERE running <= 6000 OR nth = 1)"
CONTEXTS = r"ctx AS (SELECT query_id, string_agg(block, E'\n\n---\n\n' ORDER BY source_no) AS context, count(*) AS sources FROM packed GROUP BY query_id)"


def packed(s, d):
    return g.pack(context_rows(s, d))


#: Answers: each turn's text of a conversation with citations by its number.
ANSWERS = "concat(text, ' [Source ', CAST(1 + conv_id % 4 AS STRING), '] and [', CAST(conv_id % 6 AS STRING), '].')"


def answers(s, d):
    return read(s, d, "conversations").selectExpr("conv_id * 100 + turn AS query_id", f"CASE WHEN conv_id % 5 = 0 THEN text ELSE {ANSWERS} END AS answer", "conv_id % 7 = 0 AS fallback")


_SOURCE = "CAST(query_id % 5 + source_no - 1 AS INT)", "CASE WHEN query_id % 4 = 3 AND source_no = 2 THEN '' ELSE concat('f', CAST(source_no AS STRING)) END"
ANSWERS_SQL = f"ans AS (SELECT conv_id * 100 + turn AS query_id, CASE WHEN conv_id % 5 = 0 THEN text ELSE {ANSWERS} END AS answer, conv_id % 7 = 0 AS fallback FROM conversations), src AS (SELECT conv_id * 100 + turn AS query_id, CAST(n AS INT) AS source_no FROM conversations, (VALUES (1), (2), (3)) AS t(n))"


def sources(s, d):
    numbered = answers(s, d).select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("source_no"))
    return numbered.selectExpr("*", f"{_SOURCE[0]} AS page_number", f"{_SOURCE[1]} AS filename")


def blanked(answers_):
    """Some of the answers as blanks."""
    return answers_.withColumn("answer", F.when(F.col("query_id") % 11 == 5, "  ").otherwise(F.col("answer")))


#: Each turn as an answer to the turn before it, which is also its context.
_GUARDED = {
    "answer": "CASE conv_id % 6 WHEN 1 THEN concat('and ', text) WHEN 2 THEN concat(text, ' 11 22 33 44 55') WHEN 3 THEN concat(text, ' ತೆ') WHEN 4 THEN 'ಸರಿ' ELSE text END",
    "language": "CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'kn' WHEN 2 THEN 'te' ELSE 'hi' END",
    "query": "concat(COALESCE(before, ''), CASE WHEN turn % 2 = 0 THEN ' Which portal?' ELSE '' END)",
    "context": "concat(COALESCE(before, ''), CASE WHEN turn % 3 = 0 THEN ' see https://x.org/a (22)' ELSE '' END)",
    "fallback": "conv_id % 7 = 0",
}


def guarded(s, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(s, d, "conversations").withColumn("before", before).selectExpr("conv_id * 100 + turn AS query_id", *[f"{x} AS {n}" for n, x in _GUARDED.items()], "conv_id % 5 AS source")
    return rows.withColumns({"cited": F.array("source"), "known": F.array(*map(F.lit, (0, 1, 2, 3))).cast("array<bigint>")})


def _has(script: str) -> str:
    return f"regexp_matches(a, '{tx.BLOCKS[script]}')"


_OWN = f"CASE language WHEN 'te' THEN {_has('telugu')} WHEN 'kn' THEN {_has('kannada')} WHEN 'hi' THEN {_has('devanagari')} END"
_FOREIGN = f"CASE language WHEN 'te' THEN {_has('kannada')} WHEN 'kn' THEN {_has('telugu')} WHEN 'hi' THEN {_has('kannada')} OR {_has('telugu')} END"
_LOOSE = f"len(list_filter(list_distinct(regexp_extract_all(a, '{tx.NUMBER}')), lambda n: NOT list_contains(regexp_extract_all(context, '{tx.NUMBER}'), n) AND NOT COALESCE(regexp_full_match(n, '\\d+') AND TRY_CAST(n AS HUGEINT) <= 10, false)))"
_URL_SQL = g.GUARD_URL.replace("'", "''")
_URL_LABEL = "CASE language WHEN 'hi' THEN 'आधिकारिक पोर्टल / वेबसाइट: ' WHEN 'kn' THEN 'ಅಧಿಕೃತ ವೆಬ್‌ಸೈಟ್: ' WHEN 'te' THEN 'అధికారిక వెబ్‌సైట్: ' ELSE 'Official Portal / Website: ' END"
GUARDED_ROWS = f"SELECT conv_id * 100 + turn AS query_id, {', '.join(f'{x} AS {n}' for n, x in _GUARDED.items())}, conv_id % 5 AS source FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
GUARD = (
    "SELECT query_id, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'REJECT' END AS status, reason, "
    f"CASE WHEN NOT fallback AND ({' OR '.join(f'contains(lower(query), {chr(39)}{w}{chr(39)})' for w in g.GUARD_URL_WORDS)}) AND regexp_matches(context, '{_URL_SQL}') AND NOT regexp_matches(a, '{_URL_SQL}') THEN concat(a, chr(10), chr(10), {_URL_LABEL}, regexp_extract(context, '{_URL_SQL}')) ELSE a END AS answer "
    f"FROM (SELECT *, CASE WHEN fallback THEN NULL WHEN {_LOOSE} > 3 THEN 'NUMBER_MISMATCH' WHEN regexp_matches(a, '{g.GUARD_FRAGMENT}') THEN 'FRAGMENTARY_ANSWER' WHEN NOT ({_OWN}) AND length(a) > 15 THEN 'MISSING_TARGET_SCRIPT' WHEN {_FOREIGN} THEN 'SCRIPT_CONTAMINATION' WHEN source = 4 THEN 'INVALID_CITATION' END AS reason "
    f"FROM (SELECT *, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a FROM ({GUARDED_ROWS})))"
)

CITED = r"cited AS (SELECT query_id, CAST(n AS INT) AS source_no FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(answer, '(?i)\[(?:Source\s*)?(\d{1,9})\]', 1))) AS n FROM ans)), resolved AS (SELECT c.query_id, c.source_no, s.source_no IS NOT NULL AS valid FROM cited c LEFT JOIN src s USING (query_id, source_no) UNION ALL SELECT query_id, source_no, true FROM src WHERE query_id IN (SELECT query_id FROM ans WHERE trim(answer) <> '' AND query_id NOT IN (SELECT query_id FROM cited)))"


#: Two states of the index over all documents: some have other chunk and document ids in one of them, some another text.
def _state_columns(renamed: int, version: int) -> list[str]:
    doc = f"CASE WHEN doc_id % {renamed} = 0 THEN -1 - doc_id ELSE doc_id END"
    changed = f"concat(text, CASE WHEN doc_id % 11 = 0 THEN '{version}' ELSE '' END)"
    return [f"concat('D:', CAST({doc} AS STRING)) AS chunk_id", f"{doc} AS doc_id", f"sha256({changed}) AS content_hash", "text"]


def state(s, d, renamed: int, version: int):
    """A state of the index; the hash is of the whole text."""
    return read(s, d, "documents").selectExpr(*[x.replace("sha256(", "sha2(").replace(") AS content_hash", ", 256) AS content_hash") for x in _state_columns(renamed, version)])


def _state(renamed: int, version: int) -> str:
    return f"(SELECT {', '.join(_state_columns(renamed, version))} FROM documents)"


OLD, NEW = (7, 1), (5, 2)
STATES = f"old AS {_state(*OLD)}, new AS {_state(*NEW)}"
ACTIONS = "actions AS (SELECT n.chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.content_hash = o.content_hash THEN 'skip' ELSE 'update' END AS action FROM new n LEFT JOIN old o USING (chunk_id))"


def registry(s, d, renamed, tag):
    return read(s, d, "documents").selectExpr(f"CASE WHEN doc_id % {renamed} = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id", f"concat('{tag}', CAST(doc_id % 3 AS STRING)) AS title", "source AS category", "doc_id % 4 <> 0 AS is_active")


def _registry(renamed, tag):
    return f"(SELECT CASE WHEN doc_id % {renamed} = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, concat('{tag}', CAST(doc_id % 3 AS STRING)) AS title, source AS category, doc_id % 4 <> 0 AS is_active FROM documents)"


def variants(s, d):
    """Ranked lists of three variants of each query: the text, its first half, its second half."""
    q = asked(s, d)
    half = F.floor(F.length("text") / 2).cast("int")
    parts = {"whole": F.col("text"), "head": F.col("text").substr(F.lit(1), half), "tail": F.col("text").substr(half + 1, F.length("text"))}
    found = [lx.search(index(s, d), q.select("query_id", x.alias("text")), 12).withColumn("variant", F.lit(n)) for n, x in parts.items()]
    return r.stacked(*[t.select("query_id", "chunk_id", "rank", "variant") for t in found])


def _variant(name: str, text: str) -> str:
    return f"{name} AS (WITH {bm25(f'SELECT item_id AS query_id, {TOKENS_SQL} AS l FROM (SELECT item_id, {text} AS text FROM benchmark)')} SELECT query_id, chunk_id, rank, '{name}' AS variant FROM lex)"


BEST_RANK = (
    f"WITH {_variant('whole', 'text')}, {_variant('head', 'substring(text, 1, length(text) // 2)')}, {_variant('tail', 'substring(text, length(text) // 2 + 1)')}, found AS (SELECT * FROM whole UNION ALL SELECT * FROM head UNION ALL SELECT * FROM tail) "
    "SELECT query_id, chunk_id, min(rank) AS best_rank, string_agg(variant, ',' ORDER BY variant) AS variants, floor((CAST(1 AS DOUBLE) / (60 + min(rank)) + (count(*) - 1) * CAST(0.0001 AS DOUBLE)) * 1000000 + 0.5) / 1000000 AS fused_score FROM found GROUP BY query_id, chunk_id"
)


def asked_labels(s, d):
    """Queries with the label they want, if another vector has it."""
    labels = vectors(s, d).groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    return vector_queries(s, d).select("query_id", F.col("wanted").alias("category")).join(labels.select(F.col("label").alias("category")), "category", "left_semi")


def label_hits(s, d, found):
    """Results of the label that their query wants, but for the query's own vector: k rows a query meet the labels."""
    wanted = vector_queries(s, d).select("query_id", "wanted")
    placed = found.select("query_id", "chunk_id", "rank").join(wanted, "query_id").join(vectors(s, d).select("chunk_id", "label"), "chunk_id")
    return placed.filter("wanted = label AND query_id <> chunk_id").select("query_id", "rank")


GOLD = "gold AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS category FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"
HITS = "SELECT {by} count(*) AS queries, {one} AS hit_at_1, {three} AS hit_at_3, {five} AS hit_at_5, floor(avg(COALESCE(CAST(1 AS DOUBLE) / hit, 0)) * 10000 + 0.5) / 10000 AS mrr FROM (SELECT DISTINCT query_id, category FROM gold) LEFT JOIN (SELECT query_id, min(rank) AS hit FROM {res} JOIN gold USING (query_id, chunk_id) GROUP BY query_id) USING (query_id) {group}"


def hits(res: str, by: str) -> str:
    at = lambda n: f"floor(avg(CASE WHEN hit <= {n} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 10000 + 0.5) / 10000"
    return HITS.format(by=f"{by}," if by else "", one=at(1), three=at(3), five=at(5), res=res, group=f"GROUP BY {by}" if by else "")


def ablation(s, d):
    """All three configurations are judged in one pass: a question of each is a question of its own."""
    a, b = lists(s, d)
    named = {"dense": a, "lexical": b, "rrf": r.top_k(r.rrf(a, b), 12, "rrf_score")}
    of = F.struct("config_name", "query_id").alias("query_id")
    placed = r.stacked(*[found.select("query_id", "chunk_id", "rank", F.lit(n).alias("config_name")) for n, found in named.items()])
    wanted = vector_queries(s, d).select("query_id", "wanted")
    judged = placed.join(wanted, "query_id").join(vectors(s, d).select("chunk_id", "label"), "chunk_id").filter("wanted = label AND query_id <> chunk_id")
    asked_ = asked_labels(s, d).withColumn("config_name", F.explode(F.array(*map(F.lit, named)))).select(of, "config_name")
    found = r.evaluate(asked_, judged.select(of, "rank"), "config_name")
    return found.select(*[c for c in found.columns if c != "config_name"], "config_name")


QUERIES = {
    "ag27_term_statistics": (lambda s, d: lx.term_statistics(index(s, d)), with_("SELECT term, df FROM df", BM25.split(", qt AS")[0])),
    "jb12_bm25_search": (lambda s, d: lexical(s, d).select("query_id", "chunk_id", "score", "lexical_score", "rank"), with_("SELECT query_id, chunk_id, score, floor(score / max(score) OVER (PARTITION BY query_id) * 10000 + 0.5) / 10000 AS lexical_score, rank FROM lex", BM25)),
    "prj10_bm25_filtered": (lambda s, d: lx.search(index(s, d), asked(s, d), 5, chunks(s, d).filter(r.metadata_filter(lang="en", page_number=1))).select("query_id", "chunk_id", "score", "rank"), with_("SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM bm JOIN documents ON doc_id = chunk_id WHERE lang = 'en' AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5", BM25)),
    "jb13_dense_search": (lambda s, d: dense(s, d), with_("SELECT * FROM den", _dense("den"))),
    "mt02_cosine": (lambda s, d: vectors(s, d).select("chunk_id", rounded(cosine(F.col("embedding"), F.reverse("embedding")), 4).alias("self_cosine")), "SELECT vec_id AS chunk_id, floor(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), list_cosine_similarity(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), list_reverse(list_transform(embedding, lambda v: CAST(v AS DOUBLE)))))) * 10000 + 0.5) / 10000 AS self_cosine FROM embeddings"),
    "mt08_embedding_contract": (lambda s, d: ix.embedding_contract(vectors(s, d), 64), "SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) = 64) AS valid, count(*) FILTER (WHERE len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) - 1) < 0.001) AS unit FROM embeddings"),
    "mt09_unit": (lambda s, d: vectors(s, d).select("chunk_id", rounded(F.array_max(unit(F.col("embedding"))), 5).alias("largest")), "SELECT vec_id AS chunk_id, floor(list_max(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) * 100000 + 0.5) / 100000 AS largest FROM embeddings"),
    "jn05_merge_candidates": (lambda s, d: r.merge_candidates(*lists(s, d)), with_("SELECT * FROM merged", LISTS, MERGED)),
    "mt03_rrf": (lambda s, d: r.rrf(*lists(s, d)), with_("SELECT * FROM rrf", LISTS, RANKED, RRF)),
    "mt04_weighted_rrf": (
        lambda s, d: r.weighted_rrf(*lists(s, d)).select("query_id", "chunk_id", "rrf_score", "dense_score", "lexical_score", "methods", "rank"),
        with_(
            "SELECT query_id, chunk_id, rrf_score, dense_score, lexical_score, methods, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, COALESCE(dense_score, 0) DESC, COALESCE(lexical_score, 0) DESC, chunk_id DESC) AS INT) AS rank FROM (SELECT query_id, chunk_id, floor(raw / max(raw) OVER (PARTITION BY query_id) * 10000 + 0.5) / 10000 AS rrf_score FROM (SELECT query_id, chunk_id, sum(CASE method WHEN 'dense' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END / (60 + rank)) AS raw FROM ranked GROUP BY ALL)) JOIN merged USING (query_id, chunk_id)",
            LISTS, RANKED, MERGED,
        ),
    ),
    "mt05_best_rank": (lambda s, d: r.best_rank_rrf(variants(s, d)), BEST_RANK),
    "mt06_linear_fusion": (
        lambda s, d: r.linear_fusion(*lists(s, d), chunks(s, d).select("chunk_id", "text")).select("query_id", "chunk_id", "hybrid_score", "rank"),
        with_("SELECT query_id, chunk_id, hybrid_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, length(text) NULLS FIRST, chunk_id DESC) AS INT) AS rank FROM (SELECT query_id, chunk_id, floor(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (CAST(0.7 AS DOUBLE) * COALESCE(dense_score, 0) + CAST(0.3 AS DOUBLE) * COALESCE(lexical_score, 0)) / (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE)))) * 10000 + 0.5) / 10000 AS hybrid_score FROM merged) LEFT JOIN documents ON doc_id = chunk_id", LISTS, MERGED),
    ),
    "jb14_hybrid_search": (lambda s, d: r.hybrid_search(*lists(s, d)), with_("SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS INT) AS rank FROM rrf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) <= 5", LISTS, RANKED, RRF)),
    "jb17_rerank": (lambda s, d: r.rerank(r.hydrate(lexical(s, d).select("query_id", "chunk_id", F.col("lexical_score").alias("rrf_score")), chunks(s, d)).join(asked(s, d).withColumnRenamed("text", "query"), "query_id")), None),
    "jb18_evidence_gate": (lambda s, d: g.evidence_gate(r.hydrate(lexical(s, d).select("query_id", "chunk_id", "rank", F.col("lexical_score").alias("score")), chunks(s, d)).join(asked(s, d).withColumnRenamed("text", "query"), "query_id")), None),
    "jb19_keyword_gate": (
        lambda s, d: g.keyword_gate(asked(s, d).withColumnRenamed("text", "query"), g.contexts(packed(s, d))),
        with_(
            f"SELECT query_id, CAST(len(c) AS INT) AS content_words, CAST(len(list_intersect(c, x)) AS INT) AS shared_words, (len(c) = 0 OR regexp_matches(text, '[\\x{{0900}}-\\x{{0D7F}}]')) OR len(list_intersect(c, x)) >= CASE WHEN len(c) >= 3 THEN 2 ELSE 1 END AS passes FROM (SELECT item_id AS query_id, text, list_filter(list_distinct({TOKENS_SQL}), lambda t: regexp_matches(t, '^[a-z]{{3,}}$') AND t NOT IN ({_list(g.GATE_STOP)})) AS c, list_filter(list_distinct({TOKENS_SQL.replace("(text", "(COALESCE(context, '')")}), lambda t: regexp_matches(t, '^[a-z]{{3,}}$')) AS x FROM benchmark LEFT JOIN ctx ON item_id = query_id)",
            BM25, PACKED, CONTEXTS,
        ),
    ),
    "wn05_context_budget": (packed, with_("SELECT * FROM packed", BM25, PACKED)),
    "jb20_build_context": (lambda s, d: g.contexts(packed(s, d)), with_("SELECT * FROM ctx", BM25, PACKED, CONTEXTS)),
    "jb22_prompts": (lambda s, d: g.prompts(asked(s, d).select("query_id", F.col("text").alias("query"), F.lit("en").alias("language")), g.contexts(packed(s, d))), with_(r"SELECT item_id AS query_id, concat(E'Context:\n', COALESCE(context, ''), E'\n\nQuestion: ', text, E'\nAnswer in en, citing sources as [Source n].') AS prompt FROM benchmark LEFT JOIN ctx ON item_id = query_id", BM25, PACKED, CONTEXTS)),
    "jb23_resolve_citations": (lambda s, d: g.resolve_citations(answers(s, d), sources(s, d)), with_("SELECT * FROM resolved", ANSWERS_SQL, CITED)),
    "jb24_guard_answers": (lambda s, d: g.guard(guarded(s, d)), GUARD),
    "jb25_grounding_faults": (
        lambda s, d: g.grounding_faults(blanked(answers(s, d)), g.resolve_citations(answers(s, d), sources(s, d)), sources(s, d)),
        with_(
            f"SELECT query_id, source_no, fault FROM (SELECT query_id, source_no, unnest(list_filter([CASE WHEN fallback THEN 'fallback cites' END, CASE WHEN NOT fallback AND NOT valid THEN 'outside the context' END, CASE WHEN NOT fallback AND valid AND {_SOURCE[0]} < 1 THEN 'bad page' END, CASE WHEN NOT fallback AND valid AND {_SOURCE[1]} = '' THEN 'no file name' END], lambda x: x IS NOT NULL)) AS fault FROM resolved JOIN ans USING (query_id)) "
            "UNION ALL SELECT query_id, NULL, 'empty answer' FROM ans WHERE NOT fallback AND query_id % 11 = 5",
            ANSWERS_SQL, CITED,
        ),
    ),
    "tx23_cited_indices": (lambda s, d: answers(s, d).select("query_id", F.array_join(tx.cited_indices(F.col("answer")), ",").alias("cited")), with_(r"SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM (SELECT query_id, regexp_extract_all(answer, '(?i)\[(?:Source\s*)?(\d{1,9})\]', 1) AS l FROM ans)", ANSWERS_SQL)),
    "ag29_retrieval_quality": (lambda s, d: r.evaluate(asked_labels(s, d), label_hits(s, d, dense(s, d)), "category"), with_(hits("den", "category"), _dense("den"), GOLD)),
    "jb27_retrieval_quality_all": (lambda s, d: r.evaluate(asked_labels(s, d), label_hits(s, d, dense(s, d))), with_(hits("den", ""), _dense("den"), GOLD)),
    "ag30_ablation": (
        ablation,
        with_(" UNION ALL ".join(f"SELECT *, '{n}' AS config_name FROM ({hits(t, '')})" for n, t in (("dense", "den"), ("lexical", "lx"), ("rrf", "fused"))), LISTS, RANKED, RRF, GOLD, "fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM rrf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) <= 12)"),
    ),
    "wn13_last_turns": (lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)), "|").alias("before")), "SELECT conv_id, turn, COALESCE(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations"),
    "jn09_upsert_actions": (lambda s, d: ix.upsert_actions(state(s, d, *OLD), state(s, d, *NEW)), with_("SELECT * FROM actions", STATES, ACTIONS)),
    "jn10_stale_and_missing": (lambda s, d: ix.stale_and_missing(state(s, d, *OLD), state(s, d, *NEW)), with_("SELECT chunk_id, 'stale' AS state FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT chunk_id, 'missing' FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)", STATES)),
    "jn11_integrity": (lambda s, d: ix.integrity(registry(s, d, 5, "t"), state(s, d, *OLD)), with_("SELECT DISTINCT doc_id, 'orphan' AS state FROM old WHERE doc_id NOT IN (SELECT doc_id FROM reg) UNION ALL SELECT doc_id, 'not indexed' FROM reg WHERE is_active AND doc_id NOT IN (SELECT doc_id FROM old)", STATES, f"reg AS {_registry(5, 't')}")),
    "jn12_content_matches": (lambda s, d: ix.content_matches(state(s, d, *NEW).select("doc_id", "content_hash"), state(s, d, *OLD)), with_("SELECT n.doc_id, known_id FROM new n JOIN (SELECT content_hash, min(doc_id) AS known_id, count(*) AS known_ids FROM old GROUP BY content_hash) USING (content_hash) WHERE known_id <> n.doc_id OR known_ids > 1", STATES)),
    "jb29_index_sync": (lambda s, d: ix.sync(state(s, d, *OLD), state(s, d, *NEW))[0].select("chunk_id", "content_hash"), with_("SELECT chunk_id, content_hash FROM new", STATES)),
    "ag36_index_report": (lambda s, d: ix.sync(state(s, d, *OLD), state(s, d, *NEW))[1], with_("SELECT action, count(*) AS chunks FROM (SELECT action FROM actions UNION ALL SELECT 'remove' FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)) GROUP BY action", STATES, ACTIONS)),
    "jb30_record_faults": (lambda s, d: ix.record_faults(vectors(s, d).select(F.when(F.col("chunk_id") % 9 == 0, F.lit("x")).otherwise(F.concat(F.lit("v:"), F.col("chunk_id").cast("string"))).alias("chunk_id"), F.when(F.col("chunk_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.when(F.col("chunk_id") % 13 == 0, F.lit(" ")).otherwise(F.lit("t")).alias("text")), 64), with_("SELECT chunk_id, 'bad id' AS fault FROM v WHERE n % 9 = 0 UNION ALL SELECT chunk_id, 'bad vector' FROM v WHERE n % 10 = 0 UNION ALL SELECT chunk_id, 'no text' FROM v WHERE n % 13 = 0", "v AS (SELECT vec_id AS n, CASE WHEN vec_id % 9 = 0 THEN 'x' ELSE concat('v:', CAST(vec_id AS STRING)) END AS chunk_id FROM embeddings)")),
    "jb33_delete_documents": (lambda s, d: ix.delete_documents(read(s, d, "labels"), read(s, d, "documents").filter("lang = 'fr'")).select("doc_id", "quality", "toxic"), "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')"),
    "jb34_sync_registry": (lambda s, d: ix.sync_registry(registry(s, d, 5, "t"), registry(s, d, 7, "u").withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.col("title")))), with_("SELECT COALESCE(m.doc_id, r.doc_id) AS doc_id, COALESCE(m.title, r.title) AS title, COALESCE(m.category, r.category) AS category, COALESCE(m.is_active, r.is_active) AS is_active, CASE WHEN r.doc_id IS NULL THEN 'insert' WHEN m.doc_id IS NULL OR m.title = r.title THEN 'keep' ELSE 'update' END AS action FROM r FULL JOIN m ON r.doc_id = m.doc_id", f"r AS {_registry(5, 't')}", f"m AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN concat('t', CAST(doc_id % 3 AS STRING)) ELSE title END AS title) FROM {_registry(7, 'u')})")),
    "prj13_active_documents": (lambda s, d: registry(s, d, 5, "t").filter("is_active AND category = 'src3'").orderBy("title"), with_("SELECT * FROM reg WHERE is_active AND category = 'src3'", f"reg AS {_registry(5, 't')}")),
}
