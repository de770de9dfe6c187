"""Query understanding: follow-ups, dictionary expansion, variants, and the whole row of a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Signs of a follow-up, and what earlier turns were about (signs -> topic, in order).
FOLLOW_UP = r"\b(it|this|that|them|the same|its|their)\b|\bwhat\s+happens\s+if\s+i\s+don'?t\b|\bwhat\s+if\s+i\s+fail\b|\bwhat\s+is\s+the\s+fee\b|\bwhere\s+can\s+i\s+apply\b"
FEE_QUESTIONS = ["what is the fee?", "how much is the fee?", "what is the fee", "fee?"]
APPLY_QUESTIONS = ["where can i apply?", "where to apply?", "how to apply?", "how to apply"]
TOPICS = {
    "attendance requirement": ["attendance", "उपस्थिति", "ಹಾಜರಾತಿ", "హాజరు"],
    "CGTMSE credit guarantee scheme": ["cgtmse", "credit guarantee", "गारंटी", "గ్యారెంటీ"],
    "NIRF rating management": ["nirf"],
    "revaluation of answer scripts": ["revaluation", "photocopy", "पुनर्मूल्यांकन", "ಮರುಮೌಲ್ಯಮಾಪನ"],
    "scholarship": ["scholarship", "छात्रवृत्ति", "ಸ್ಕಾಲರ್‌ಶಿಪ್"],
    "hostel": ["hostel", "curfew"],
    "placement registration": ["placement", "प्लेसमेंट"],
}


def topic(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """The first topic of which a text holds a sign."""
    held = lambda signs: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(s)) for s in signs])
    return F.coalesce(*[F.when(held(signs), F.lit(name)) for name, signs in (topics or TOPICS).items()])


def resolve_follow_up(query: Column, before: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """TX18: the query with the topic of the newest turn in ``before`` (oldest first) that has one."""
    found = F.try_element_at(F.filter(F.transform(before, lambda t: topic(t, topics)), lambda t: t.isNotNull()), F.lit(-1))
    q = tx.strip(F.lower(query))
    rewritten = (
        F.when(F.contains(q, F.lit("meet it")), F.concat(F.lit("What happens if a student does not meet the "), found, F.lit("?")))
        .when(q.isin(*FEE_QUESTIONS), F.concat(F.lit("What is the fee for "), found, F.lit("?")))
        .when(q.isin(*APPLY_QUESTIONS), F.concat(F.lit("How and where to apply for "), found, F.lit("?")))
        .when(F.array_contains(F.split(q, r"(?U)\s+"), "it"), F.regexp_replace(query, F.lit(r"(?i)\bit\b"), found)).otherwise(F.concat(query, F.lit(" regarding "), found))
    )
    return F.when((F.size(before) > 0) & q.rlike(FOLLOW_UP) & found.isNotNull(), rewritten).otherwise(query)


def last_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """WN13: with ``before``: the texts of the last ``n`` turns of the conversation."""
    return turns.withColumn("before", F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)))


def dictionary_matches(queries: DataFrame, dictionary: DataFrame, longest: int = 3) -> DataFrame:
    """JN15: (query_id, term, expansion) by whole words, through an equi-join on runs of up to ``longest`` words.

    A term that lies inside a longer one that the query also holds is left out.
    """
    tokens = queries.select("query_id", tx.tokenize(F.col("text")).alias("tokens"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - n + 1)), lambda i: F.array_join(F.slice("tokens", i, n), " "))))
    held = tokens.select("query_id", F.explode(F.array_distinct(runs)).alias("term")).join(dictionary, "term")
    longer = held.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    inside = F.exists("terms", lambda t: (F.length(t) > F.length("term")) & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    return held.join(longer, "query_id").filter(~inside).select("query_id", "term", "expansion")


# Questions about guarantees and schemes aren't about the credits of courses.
SCHEME_WORDS = ("गारंटी", "ग್ಯಾರಂಟಿ", "గ్యారెంటీ", "guarantee", "cgtmse", "योजना", "ಯೋಜನೆ", "స్కీమ్", "scheme", "msme")
CREDIT_TERMS = ("क्रेडिट", "ಕ್ರೆಡಿಟ್", "క్రెడిట్స్", "credits")


def phrase_matches(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN15: (query_id, term, expansion) for the terms of ``dictionary`` (term, expansion, anywhere) that a query holds, in lower case.

    Terms that may stand ``anywhere`` are found inside words too, as endings are joined to Indic ones, but not if they lie in a longer
    such term that the query holds; other terms stand as whole words. Terms of course credits don't count in a question about a scheme.

    Scale: a query's letters meet the dictionary in an equi-join on the first three letters of a term, and are compared with the whole term
    there; neither side is sent to all tasks or needs to fit in memory.
    """
    longest = dictionary.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]
    scheme = reduce(lambda a, b: a | b, [F.contains("q", F.lit(w)) for w in SCHEME_WORDS])
    q = queries.select("query_id", F.lower("text").alias("q")).filter("q <> ''").withColumn("scheme", scheme)
    places = q.select("query_id", "q", "scheme", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("at"))
    places = places.select("query_id", "scheme", F.when(F.col("at") > 1, F.col("q").substr(F.col("at") - 1, F.lit(1))).alias("before"), F.col("q").substr(F.col("at"), F.lit(longest + 1)).alias("here"))
    starts = places.select("*", F.explode(F.array_distinct(F.array(*[F.substring("here", 1, n) for n in (1, 2, 3)]))).alias("start"))
    keys = dictionary.filter("term <> ''").select("term", "expansion", "anywhere", F.substring("term", 1, 3).alias("start"))
    met = starts.join(keys, "start").filter(F.startswith("here", "term"))
    is_word = lambda c: F.coalesce(c.rlike(r"(?U)^\w"), F.lit(False))
    letter = lambda i: F.col("here").substr(i, F.lit(1))
    edges = (is_word(F.col("before")) != is_word(letter(F.lit(1)))) & (is_word(letter(F.length("term"))) != is_word(letter(F.length("term") + 1)))
    held = met.filter((F.col("anywhere") | edges) & ~(F.col("scheme") & F.col("term").isin(*CREDIT_TERMS))).select("query_id", "term", "expansion", "anywhere").distinct()
    longer = held.filter("anywhere").groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    inside = F.coalesce(F.exists("terms", lambda t: (F.length(t) > F.length("term")) & F.contains(t, F.col("term"))), F.lit(False))
    return held.join(longer, "query_id", "left").filter(~(F.col("anywhere") & inside)).select("query_id", "term", "expansion")


def expand(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JB16: (query_id, variant_no, variant_type, variant_text, weight): the query, and up to two variants by expansions of its longest terms.

    ``queries``: query_id, text and, if known, language, is_romanized and is_code_mixed. One that isn't plain English gets three expansions at
    0.85; all get two as synonyms at 0.80, unless that is the same text. An expansion that says the query again isn't used. ``dictionary`` is that
    of ``phrase_matches``, or without ``anywhere`` that of ``dictionary_matches``.
    """
    known = lambda c, none: F.col(c) if c in queries.columns else F.lit(none)
    romanized = F.coalesce(known("is_romanized", False), F.lit(False))
    foreign = romanized | F.coalesce(known("language", "en").isin("hi", "kn", "te"), F.lit(False)) | F.coalesce(known("is_code_mixed", False), F.lit(False))
    first = queries.select("query_id", F.lit(1).alias("variant_no"), F.lit("original").alias("variant_type"), F.col("text").alias("variant_text"), F.lit(1.0).alias("weight"))
    ordered = F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("n"), "term", "expansion")))
    matches = phrase_matches if "anywhere" in dictionary.columns else dictionary_matches
    found = matches(queries, dictionary).groupBy("query_id").agg(tx.distinct_spellings(F.transform(ordered, lambda x: x["expansion"])).alias("e"))
    rows = queries.select("query_id", "text", romanized.alias("romanized"), foreign.alias("foreign")).join(found, "query_id").withColumn("e", F.filter("e", lambda x: F.lower(x) != F.lower("text"))).filter(F.size("e") > 0)
    three, two = (F.array_join(F.slice("e", 1, n), " ") for n in (3, 2))
    made = lambda kind, text, weight: F.struct(kind.alias("variant_type"), text.alias("variant_text"), F.lit(weight).alias("weight"))
    cross = F.when(F.col("foreign"), made(F.when(F.col("romanized"), "transliteration").otherwise("indic_translation"), three, 0.85))
    synonym = F.when(~F.col("foreign") | (F.lower(three) != F.lower(two)), made(F.lit("synonym"), two, 0.8))
    more = rows.select("query_id", F.posexplode(F.array_compact(F.array(cross, synonym))).alias("at", "v")).select("query_id", (F.col("at") + 2).alias("variant_no"), "v.*")
    return first.unionByName(more)


def variants(queries: DataFrame) -> DataFrame:
    """JB15: up to three different variants of a query: as it is, in normal form, its telling words."""
    words = F.array_join(F.filter(tx.tokenize(F.col("text")), lambda t: (F.length(t) > 2) & ~t.isin(*tx.QUERY_STOP_WORDS)), " ")
    made = queries.select("query_id", F.array(tx.strip(F.col("text")), tx.normalize_query(F.col("text")), words).alias("made"))
    kept = F.filter("made", lambda v, i: (v != "") & (F.array_position(F.transform("made", F.lower), F.lower(v)) == i + 1))
    return made.select("query_id", F.posexplode(kept).alias("at", "text")).select("query_id", F.concat(F.lit("v"), (F.col("at") + 1).cast("string")).alias("variant"), "text")


def understand(queries: DataFrame) -> DataFrame:
    """JB35: everything that is known of a query, in one projection; ``queries`` has query_id, text and before."""
    q = F.col("normalized")
    rows = queries.withColumn("normalized", tx.normalize_query(resolve_follow_up(F.col("text"), F.col("before"))))
    roman = tx.romanized(q)
    return rows.select(
        "query_id", "normalized", tx.query_language(q).alias("language"), tx.primary_script(q).alias("script"), tx.is_code_mixed(q).alias("is_code_mixed"), (roman["language"].isNotNull() & (roman["confidence"] >= 0.5)).alias("is_romanized"),
        tx.query_intent(q).alias("intent"), F.array_join(tx.entities(q), "|").alias("entities"), F.array_join(tx.important_terms(q), " ").alias("terms"), F.map_from_arrays(F.array(*map(F.lit, tx.script_shares(q))), F.array(*tx.script_shares(q).values())).alias("script_distribution"),
    )
