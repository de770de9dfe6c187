"""Grounding: context packing, gates, citations and answer checks over tables of queries and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded

# Limits and patterns of the grounding rules.
CONTEXT_LIMIT = 6000
INJECTION = [r"(?i)ignore\s+(all\s+)?(prior|previous)\s+instructions", r"(?i)disregard\s+(all\s+)?(rules|documentation|system)", r"(?i)system\s+(override|prompt)", r"(?i)admin\s+access\s+granted"]
GATE_GENERIC = (
    "what is the in for to of and a an on are how do does did explain about which where can be who whom whose when why won was were been have has policy guidelines rules system campus college details "
    "student students faculty staff university department required requirement requirements need needed tell give provide using used applicable apply must shall only per as such document documents section page query question questions"
).split()
GATE_TOPICS = (
    "attendance attend condonation cgtmse guarantee credit credits revaluation photocopy challenge supplementary makeup fast-track backlog scholarship merit hostel placement debarment eligibility grade malpractice database mysql electron backend frontend "
    "proctoring nirf reimbursement incubation aspire sfurti msme curfew stipend fine penalty admission fastapi react vite tailwind"
).split()
GUARD_FRAGMENT = r"(?i)^(?:fee\.|is\b|are\b|was\b|were\b|less to\b|whichever\b|and\b|or\b)"
GUARD_URL = r"(?i)https?://[^\s<>\"'()]+|www\.[^\s<>\"'()]+"
GUARD_URL_WORDS = [
    "website", "portal", "url", "link", "site", "where to apply", "how to apply", "application", "apply", "वेबसाइट", "पोर्टल", "आवेदन", "ಲಿಂಕ್", "ವೆಬ್‌ಸೈಟ್", "ಪೋರ್ಟಲ್", "అర్జి",
    "వెబ్‌సైట్", "పోర్టల్", "లింక్", "దరఖాస్తు",
]
URL_WORDS = ["website", "portal", "url", "link", "site", "where to apply", "how to apply", "वेबसाइट", "पोर्टल", "ವೆಬ್‌ಸೈಟ್", "ಪೋರ್ಟಲ್", "వెబ్‌సైట్", "పోర్టల్"]
GATE_STOP = "what the for and how does where can which who when tell about today now".split()


def response_state(available: Column, grounded: Column) -> Column:
    """PRJ11."""
    return F.when(~available, "LANGUAGE_UNAVAILABLE").when(grounded, "GROUNDED").otherwise("INSUFFICIENT_EVIDENCE")


def pack(candidates: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """JB20, WN5: (query_id, source_no, chunk_id, block): leading blocks while their running length fits; the first is always in.

    Blank texts are left out but keep their number; what comes after the first block that doesn't fit is out too.
    """
    text = tx.strip(F.col("text"))
    place = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" · "), "section_title")).otherwise(""))
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), "filename", F.lit(" ("), place, F.lit(")\n"), text)
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.filter(text != "").withColumn("block", block).withColumn("running", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("nth", F.row_number().over(order)).filter((F.col("running") <= limit) | (F.col("nth") == 1)).select("query_id", F.col("rank").alias("source_no"), "chunk_id", "block")


def contexts(packed: DataFrame) -> DataFrame:
    """One row a query: the serialised context and its number of sources; a context holds at most the limit and one block."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_no", "block"))), lambda x: x["block"]), "\n\n---\n\n")
    return packed.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("sources"))


def stitched(chunks: DataFrame) -> DataFrame:
    """WN6: runs of neighbouring chunks of one section as one block, with first and last index."""
    order = Window.partitionBy("query_id", "doc_id", "section_title").orderBy("chunk_index")
    island = F.col("chunk_index") - F.row_number().over(order)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ")
    return chunks.withColumn("island", island).groupBy("query_id", "doc_id", "section_title", "island").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), joined.alias("text")).drop("island")


def merge_overlap(left: Column, right: Column, least: int = 11, most: int = 150) -> Column:
    """JB21: ``left`` and ``right`` as one text, their longest common seam of ``least`` to ``most`` characters once."""
    ends = F.array(F.struct(F.right(left, F.lit(most)).alias("tail"), F.substring(right, 1, most).alias("head")))
    sizes = lambda x: F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.length(x["tail"]), F.length(x["head"]))))
    longest = lambda x: F.array_max(F.filter(sizes(x), lambda n: F.endswith(x["tail"], F.substring(x["head"], F.lit(1), n))))
    may = lambda x: (F.length(x["tail"]) >= least) & (F.length(x["head"]) >= least) & F.contains(x["tail"], F.substring(x["head"], 1, least))
    seam = F.coalesce(F.get(F.transform(ends, lambda x: F.when(may(x), longest(x))), F.lit(0)), F.lit(0))
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.when(seam > 0, right.substr(seam + 1, F.length(right))).otherwise(F.concat(F.lit("\n\n"), right))))


def neighbours(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN7: the chunks before and after each chosen one: before on the same page or the one before, after in the same section."""
    wanted = chosen.select("query_id", "doc_id", F.col("chunk_index").alias("of"), F.col("page_number").alias("page"), F.col("section_title").alias("section"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).withColumn("chunk_index", F.col("of") + F.col("step"))
    found = wanted.join(chunks, ["doc_id", "chunk_index"])
    before = (F.col("step") == -1) & F.col("page_number").isin(F.col("page")) | (F.col("step") == -1) & (F.col("page_number") == F.col("page") - 1)
    after = (F.col("step") == 1) & (F.col("section_title") == F.col("section")) & (F.col("page_number") == F.col("page"))
    return found.filter(before | after).select("query_id", "doc_id", "of", "step", "chunk_index")


def stitched_contexts(candidates: DataFrame, chunks: DataFrame, most: int = 5, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """JB21: (query_id, context, sources, truncated) of the first ``most`` candidates, neighbouring chunks as one block.

    ``candidates``: query_id, rank, doc_id, chunk_index; ``chunks``: doc_id, chunk_index, page_number, section_title, filename, text.
    A candidate that goes on from an earlier chunk takes that in, one that goes on in a later one takes that (``neighbours``): chunks are met once, for
    the candidates and what stands beside them, and what is left, at most three chunks a candidate, is dealt once by query.
    Chunks of one document, page and section are blocks by runs of their numbers, seams once; the blocks stand in the order in which their
    section was first met. They are taken while they fit; a first block that doesn't fit is cut to the limit less 200 characters.
    """
    around = F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("step")
    wanted = candidates.filter(F.col("rank") <= most).select("query_id", "doc_id", "chunk_index", "rank", around)
    wanted = wanted.groupBy("query_id", "doc_id", (F.col("chunk_index") + F.col("step")).alias("chunk_index")).agg(F.min(F.when(F.col("step") == 0, F.col("rank"))).alias("own"))
    found = wanted.join(chunks.select("doc_id", "chunk_index", "page_number", "section_title", "filename", "text"), ["doc_id", "chunk_index"]).repartition("query_id")
    chosen = lambda c: F.when(F.col("own").isNotNull(), c)
    goes_on = lambda rule: F.max(F.when(chosen(rule(F.col("text"))), F.struct("own", F.col("page_number").alias("page"), F.col("section_title").alias("section"))))
    order = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    rows = found.withColumns({"later": goes_on(tx.is_continuation).over(order.rangeBetween(1, 1)), "earlier": goes_on(tx.is_incomplete).over(order.rangeBetween(-1, -1))})
    before = F.when((F.col("page_number") == F.col("later.page")) | (F.col("page_number") == F.col("later.page") - 1), F.struct(F.lit(1).alias("late"), F.col("later.own").alias("rank"), F.lit(-1).alias("step")))
    after = F.when((F.col("section_title") == F.col("earlier.section")) & (F.col("page_number") == F.col("earlier.page")), F.struct(F.lit(1).alias("late"), F.col("earlier.own").alias("rank"), F.lit(1).alias("step")))
    met = F.coalesce(chosen(F.struct(F.lit(0).alias("late"), F.col("own").alias("rank"), F.lit(0).alias("step"))), F.least(before, after))
    rows = rows.withColumn("met", met).filter("met IS NOT NULL").withColumn("section", F.when(F.coalesce("section_title", F.lit("")) == "", "General").otherwise(F.col("section_title")))
    group = Window.partitionBy("query_id", "doc_id", "page_number", "section")
    rows = rows.withColumn("group_met", F.min("met").over(group)).withColumn("island", F.col("chunk_index") - F.row_number().over(group.orderBy("chunk_index")))
    texts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    blocks = rows.groupBy("query_id", "doc_id", "page_number", "section", "island", "group_met").agg(F.first("filename").alias("filename"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), texts.alias("texts"))
    blocks = blocks.withColumn("texts", F.transform("texts", lambda x: tx.strip(x["text"])))
    merged = F.aggregate(F.slice("texts", 2, F.greatest(F.lit(1), F.size("texts"))), F.get("texts", F.lit(0)), lambda left, right: merge_overlap(left, right))
    blocks = blocks.withColumn("text", tx.strip(merged)).drop("texts")
    order = Window.partitionBy("query_id").orderBy("group_met", "first")
    ids = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit(".."), F.col("last").cast("string"))).otherwise(""))
    head = F.concat(F.lit("[Source "), F.col("nth").cast("string"), F.lit("]\nDocument: "), "filename", F.lit("\nPage: "), F.col("page_number").cast("string"), F.lit("\nSection: "), "section", F.lit("\nChunk ID: "), ids, F.lit("\nContent:\n"))
    blocks = blocks.withColumn("nth", F.row_number().over(order)).withColumn("head", head).withColumn("block", F.concat("head", "text", F.lit("\n")))
    blocks = blocks.withColumn("running", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("blocks", F.count("*").over(Window.partitionBy("query_id")))
    cut = F.concat("head", F.substring("text", 1, max(100, limit - 200)), F.lit("...\n"))
    kept = blocks.filter((F.col("running") <= limit) | (F.col("nth") == 1)).withColumn("block", F.when(F.col("running") <= limit, F.col("block")).otherwise(cut))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block"))), lambda x: x["block"]), "\n")
    fits = (F.count("*") == F.max("blocks")) & (F.max("running") <= limit)
    return kept.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("sources"), (~fits).alias("truncated"))


def keyword_gate(queries: DataFrame, contexts_: DataFrame) -> DataFrame:
    """JB19: queries in Latin script must share two content words with their context, or one if they have under three."""
    latin = lambda c: F.array_distinct(F.filter(tx.tokenize(c), lambda t: t.rlike("^[a-z]{3,}$")))
    content = F.filter(latin(F.col("query")), lambda t: ~t.isin(*GATE_STOP))
    shared = F.size(F.array_intersect(content, latin(F.coalesce("context", F.lit("")))))
    needed = F.when(F.size(content) >= 3, 2).otherwise(1)
    checked = (F.size(content) > 0) & ~F.col("query").rlike(r"[\x{0900}-\x{0D7F}]")
    return queries.join(contexts_, "query_id", "left").select("query_id", F.size(content).alias("content_words"), shared.alias("shared_words"), (~checked | (shared >= needed)).alias("passes"))


def evidence_gate(candidates: DataFrame, min_score: float = 0.35, min_chunks: int = 1) -> DataFrame:
    """JB18: answerability and confidence (0.40 best score + 0.35 word overlap + 0.25 agreement on the first document).

    ``candidates``: query_id, query, chunk_id, doc_id, filename, page_number, section_title, text, score, rank. One without text,
    document, file name or page doesn't count, nor does one of a Latin query that lacks all its topic words or its names.
    """
    tokens = F.array_distinct(tx.tokenize(F.col("query")))
    section = F.lower(F.coalesce("section_title", F.lit("")))
    rows = candidates.withColumns({"tokens": tokens, "names": F.transform(tx.entities(F.col("query")), F.lower), "latin": tx.primary_script(F.col("query")).isin("latin", "unknown"), "held": F.array_distinct(F.concat(tx.tokenize(F.col("text")), tx.tokenize(section)))})
    rows = rows.withColumns({"telling": F.filter("tokens", lambda t: ~t.isin(*GATE_GENERIC)), "core": F.array_intersect("tokens", tx.words(GATE_TOPICS))})
    on_topic = F.arrays_overlap("core", "held")
    named = F.exists("names", lambda x: F.contains(F.lower("text"), x) | F.contains(section, x))
    whole = (tx.strip(F.col("text")) != "") & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "") & (F.coalesce("filename", F.lit("")) != "") & (F.col("page_number") >= 1)
    beside = F.col("latin") & ~on_topic & ((F.size("core") > 0) | ((F.size("names") > 0) & ~named))
    rows = rows.withColumn("fits", F.coalesce((F.col("score") >= min_score) & whole & ~beside, F.lit(False))).withColumn("met", F.when(F.col("fits"), F.array_intersect("telling", "held")))
    top_doc = F.min_by(F.when(F.col("fits"), F.col("doc_id")), F.when(F.col("fits"), F.col("rank")))
    by_query = rows.groupBy("query_id").agg(
        F.first("query").alias("query"), F.first("telling").alias("telling"), F.first("core").alias("core"), F.first("latin").alias("latin"), F.max("score").alias("best"), F.count_if("fits").alias("n"), top_doc.alias("top_doc"),
        F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"),
    )
    agree = rows.filter("fits").groupBy("query_id", "doc_id").agg(F.count("*").alias("same")).withColumnRenamed("doc_id", "top_doc")
    out = by_query.join(agree, ["query_id", "top_doc"], "left")
    overlap = F.size("met") / F.greatest(F.lit(1), F.size("telling"))
    met, core_met = F.size("met"), F.arrays_overlap("core", "met")
    confidence = F.col("best") * 0.4 + overlap * 0.35 + F.coalesce("same", F.lit(0)) / F.greatest(F.lit(1), F.col("n")) * 0.25
    low = F.col("latin") & (((F.size("telling") > 0) & (met == 0)) | ((F.size("telling") >= 2) & ~core_met & ((overlap < 0.3) | (met < 2))))
    refused = F.exists(tx.words(INJECTION), lambda p: F.regexp_like("query", p)) | tx.query_intent(F.col("query")).isin("OUT_OF_DOMAIN", "AMBIGUOUS")
    status = (
        F.when(refused | low | (F.col("n") == 0), "UNANSWERABLE")
        .when((F.col("n") >= min_chunks) & ((overlap >= 0.4) | core_met | ~F.col("latin")), "ANSWERABLE").when((F.col("best") >= 0.6) | (overlap >= 0.3), "PARTIALLY_ANSWERABLE").otherwise("UNANSWERABLE")
    )
    shown = lambda c: F.when(refused, 0.0).otherwise(rounded(c, 4))
    return out.select("query_id", status.alias("status"), shown(confidence).alias("confidence"), shown(overlap).alias("term_coverage"), F.col("n").alias("qualifying"))


def prompts(queries: DataFrame, contexts_: DataFrame) -> DataFrame:
    """JB22."""
    body = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer in "), "language", F.lit(", citing sources as [Source n]."))
    return queries.join(contexts_, "query_id", "left").select("query_id", body.alias("prompt"))


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """JB23, JN8: (query_id, source_no, valid): sources an answer cites; all of its context's where it cites none."""
    cited = answers.select("query_id", F.explode(tx.cited_indices(F.col("answer"))).alias("source_no"))
    known = sources.select("query_id", "source_no", F.lit(True).alias("valid"))
    named = cited.join(known, ["query_id", "source_no"], "left").select("query_id", "source_no", F.coalesce("valid", F.lit(False)).alias("valid"))
    silent = answers.filter((F.size(tx.cited_indices(F.col("answer"))) == 0) & (F.trim("answer") != "")).select("query_id").join(known, "query_id")
    return named.unionByName(silent.select("query_id", "source_no", "valid"))


def reattach_url(query: Column, answer: Column, context: Column, language: Column) -> Column:
    """JB26: the context's first URL after the answer to a question about one, if the answer has none."""
    asks = reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(w)) for w in URL_WORDS])
    url = F.get(tx.urls(F.coalesce(context, F.lit(""))), F.lit(0))
    label = F.when(language == "hi", "आधिकारिक वेबसाइट: ").when(language == "kn", "ಅಧಿಕೃತ ವೆಬ್‌ಸೈಟ್: ").when(language == "te", "అధికారిక వెబ్‌సైట్: ").otherwise("Official Website: ")
    return F.when(asks & (F.size(tx.urls(answer)) == 0) & url.isNotNull(), F.concat(F.regexp_replace(answer, r"(?U)\s+$", ""), F.lit("\n\n"), label, url)).otherwise(answer)


def guard(answers: DataFrame) -> DataFrame:
    """JB24: PASS or REJECT with its reason, and the answer with the context's first URL where a question about one got none.

    ``answers``: query_id, query, answer, context, language, fallback, cited and known (sources). Reasons: a source that isn't known, a
    script that isn't the language's, a beginning inside a sentence, over three numbers above 10 that the context lacks;
    of several the last of these. Fallbacks pass as they are.
    """
    a, language = tx.strip(F.coalesce("answer", F.lit(""))), F.lower(F.trim("language"))
    context = F.coalesce("context", F.lit(""))
    has = lambda script: a.rlike(tx.BLOCKS[script])
    own = F.when(language == "te", has("telugu")).when(language == "kn", has("kannada")).when(language == "hi", has("devanagari"))
    foreign = F.when(language == "te", has("kannada")).when(language == "kn", has("telugu")).when(language == "hi", has("kannada") | has("telugu"))
    small = lambda n: n.rlike(r"^\d+$") & (F.try_to_number(n, F.lit("999999999999")) <= 10)
    loose = F.size(F.filter(F.array_except(tx.numbers(a), tx.numbers(context)), lambda n: ~F.coalesce(small(n), F.lit(False))))
    reason = F.coalesce(
        F.when(loose > 3, "NUMBER_MISMATCH"), F.when(a.rlike(GUARD_FRAGMENT), "FRAGMENTARY_ANSWER"), F.when(~own & (F.length(a) > 15), "MISSING_TARGET_SCRIPT"),
        F.when(foreign, "SCRIPT_CONTAMINATION"), F.when(F.size(F.array_except("cited", "known")) > 0, "INVALID_CITATION"),
    )
    asks = reduce(lambda x, y: x | y, [F.contains(F.lower("query"), F.lit(w)) for w in GUARD_URL_WORDS])
    url = F.get(F.regexp_extract_all(context, F.lit(GUARD_URL), 0), F.lit(0))
    label = F.when(language == "hi", "आधिकारिक पोर्टल / वेबसाइट: ").when(language == "kn", "ಅಧಿಕೃತ ವೆಬ್‌ಸೈಟ್: ").when(language == "te", "అధికారిక వెబ్‌సైట్: ").otherwise("Official Portal / Website: ")
    sound = F.when(asks & url.isNotNull() & ~a.rlike(GUARD_URL), F.concat(a, F.lit("\n\n"), label, url)).otherwise(a)
    reason, sound = F.when(~F.col("fallback"), reason), F.when(F.col("fallback"), a).otherwise(sound)
    return answers.select("query_id", F.when(reason.isNull(), "PASS").otherwise("REJECT").alias("status"), reason.alias("reason"), sound.alias("answer"))


def grounding_faults(answers: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """JB25: (query_id, source_no, fault): fallbacks that cite; other answers that are empty, or cite what isn't in the context, has no page or no file name.

    ``sources``: query_id, source_no, page_number, filename.
    """
    known = sources.select("query_id", "source_no", F.lit(True).alias("known"), "page_number", "filename")
    cited = citations.select("query_id", "source_no").join(answers.select("query_id", "fallback"), "query_id").join(known, ["query_id", "source_no"], "left")
    there = ~F.col("fallback") & F.col("known").isNotNull()
    faults = F.array(
        F.when(F.col("fallback"), "fallback cites"), F.when(~F.col("fallback") & F.col("known").isNull(), "outside the context"), F.when(there & F.coalesce(F.col("page_number") < 1, F.lit(True)), "bad page"),
        F.when(there & (F.coalesce("filename", F.lit("")) == ""), "no file name"),
    )
    empty = answers.filter(~F.col("fallback") & (tx.strip(F.coalesce("answer", F.lit(""))) == "")).select("query_id", F.lit(None).cast("int").alias("source_no"), F.lit("empty answer").alias("fault"))
    return cited.select("query_id", "source_no", F.explode(F.array_compact(faults)).alias("fault")).unionByName(empty)


def preservation(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """AG32, JB28: one row: shares of the expected URLs and numbers that stand in the answer, and of hi, kn and te answers without a foreign script.

    ``answers``: query_id, answer; ``gold``: query_id, language, expected_url, expected_number (null or empty: none expected).
    """
    rows = gold.join(answers.select("query_id", F.coalesce("answer", F.lit("")).alias("answer")), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    share = lambda flag, over: rounded(F.count_if(over & flag) / F.greatest(F.lit(1), F.count_if(over)), 4)
    kept = lambda c: share(F.contains("answer", c), F.coalesce(F.col(c), F.lit("")) != "").alias(f"{c[9:]}_preservation_rate")
    has = lambda script: F.col("answer").rlike(tx.BLOCKS[script])
    foreign = F.when(F.col("language") == "te", has("kannada")).when(F.col("language") == "kn", has("telugu")).otherwise(has("kannada") | has("telugu"))
    return rows.agg(kept("expected_url"), kept("expected_number"), share(~foreign, F.col("language").isin("hi", "kn", "te")).alias("script_purity_rate"))


def answer_quality(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """JB28, AG31, AG32: grounded rate over answerable questions, fallback rate over the others, citation validity over all, expected points kept."""
    rows = gold.join(answers, "query_id", "left")
    rate = lambda flag, over: rounded(F.count_if(flag & over) * 100 / F.greatest(F.lit(1), F.count_if(over)), 2)
    yes = F.lit(True)
    return rows.agg(
        F.count("*").alias("questions"), rate(F.coalesce("grounded", F.lit(False)), F.col("available")).alias("grounded_rate"), rate(F.coalesce("fallback", F.lit(False)), ~F.col("available")).alias("fallback_correct_rate"),
        rate(F.coalesce("citation_valid", F.lit(False)), yes).alias("citation_valid_rate"), rate(F.coalesce(F.contains(F.lower("answer"), F.lower("expected")), F.lit(False)), F.col("available")).alias("preserved_rate"),
    )
