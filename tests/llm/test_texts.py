import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundlake.llm import bpe, hmm, licenses, quality, sst, tokens, toxicity, wordtable
from groundlake.llm.common import documents, open_input, written

ASCII_SPACE = re.compile("[^\x20\x09-\x0d]+")

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name,words,spell", [("byte_bpe_50k.json", tokens.byte_level_words, tokens.spelled), ("word_bpe_49k.json", tokens.lone_words, str)])
def test_words_encode_as_the_whole_text(odd, spark, name, words, spell):
    path = public_tokenizers.path(name)
    whole, tokenizer = Tokenizer.from_file(path), tokens.load(path)
    by_word = tokens.WordCache(lambda ws: tokens.encode_all(tokenizer, [spell(w) for w in ws]), limit=50)
    draw = random.Random(1)
    texts = [r.text or "" for r in odd.union(odd).collect()] + [r.text for r in documents(spark, SF).collect()]
    texts += ["".join(draw.choice(["a", "b.", " ", " ", "\n", "\t", "  ", "\x1c", "\u00a0", "é", "1", "'s", "\0", "\u3000"]) for _ in range(draw.randrange(12))) for _ in range(3000)]
    for t in texts:
        assert [i for ids in next(by_word([words(t)])) for i in ids] == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_bpe_is_the_library(odd, none, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for docs in (odd, documents(spark, SF)):
        wanted = Counter()
        for r in docs.collect():
            ids = whole.encode(r.text or "", add_special_tokens=False).ids
            text = whole.decode(ids, skip_special_tokens=False)
            wanted[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        for table in (100_000, 20):
            got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, path, table).collect())
            assert got == wanted
    assert bpe.encode_documents(none, path).count() == 0


def test_token_tables_are_the_library(odd, none, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for docs in (odd, documents(spark, SF)):
        rows = [(r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [1], r.text or "") for r in docs.collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        wanted, start = Counter(), 0
        for doc_id, ids, _ in rows:
            wanted[doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
            start += len(ids)
        assert Counter(map(tuple, sst.token_shards(docs, path).collect())) == wanted
    assert sst.token_shards(none, path).count() == 0


def test_table_lookup(tmp_path):
    uri = f"file://{tmp_path}/t.sst"
    from groundlake.llm.common import open_output

    stream, commit = open_output(uri)
    writer = sst.Writer(stream, 2, block_bytes=64)
    ids = [None, *range(-50, 500, 3), 2**62]
    for i in ids:
        writer.add(sst.key_of(i), np.array([7, (i or 0) % 100], dtype="<u2").tobytes())
    writer.finish()
    commit()
    with open_input(uri) as f:
        reader = sst.Reader(f)
        assert [sst.id_of(k) for k, _ in reader] == ids and len(reader.places) > 10
        for i in ids:
            assert reader.ids(reader.get(sst.key_of(i))).tolist() == [7, (i or 0) % 100]
        missing = [i for i in range(-49, 500) if (i + 50) % 3]
        assert all(reader.get(sst.key_of(i)) is None for i in missing)


def base_scores(rows):
    learn = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter()
    for t in learn:
        counts.update([*ASCII_SPACE.findall(lower(t)), None])
    total, types = sum(counts.values()), len(counts)
    out = Counter()
    for d, t in rows:
        words = [*ASCII_SPACE.findall(lower(t)), None]
        held = d is None or zlib.crc32(str(d).encode()) % 7 == 2
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        out[d, held, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)] += 1
    return out


def test_hidden_markov_base_columns(odd, none, spark):
    for docs in (odd, documents(spark, SF)):
        rows = hmm.score_documents(docs, hmm.Settings(states=3, frequent=200, classes=64, rounds=2)).collect()
        got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == base_scores([(r.doc_id, r.text) for r in docs.collect()])
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score_documents(none).count() == 0


def test_one_state_is_the_base(spark):
    rows = hmm.score_documents(documents(spark, SF), hmm.Settings(states=1, frequent=50, classes=16, rounds=2, unigram=1.0)).collect()
    assert all(abs(r.score - r.base_score) < 1e-6 * abs(r.base_score) for r in rows)


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_forward_and_counts_are_sums_over_all_paths(span):
    from itertools import product

    draw = np.random.default_rng(1)
    start, move, emit = draw.dirichlet([1, 1]), draw.dirichlet([1, 1], 2), draw.dirichlet(np.ones(4), 2).T
    rows = [np.array([0, 3, 1, 2]), np.array([2, 2, 0]), np.array([1])]
    counts, moves, starts = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    total = hmm.expected_counts(rows, start, move, emit, counts, moves, starts, span)
    want_counts, want_moves, logs = np.zeros((4, 2)), np.zeros((2, 2)), []
    for r in rows:
        weights = {p: start[p[0]] * emit[r[0], p[0]] * np.prod([move[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], r[1:])]) for p in product(range(2), repeat=len(r))}
        whole = sum(weights.values())
        logs.append(math.log(whole))
        for p, w in weights.items():
            for s, x in zip(p, r):
                want_counts[x, s] += w / whole
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w / whole
    assert np.allclose(hmm.likelihoods(rows, start, move, emit), logs) and np.isclose(total, sum(logs), rtol=1e-5)
    assert np.allclose(counts, want_counts, atol=1e-5) and np.allclose(moves, want_moves, atol=1e-5)


def test_training_raises_the_likelihood(spark):
    s = hmm.Settings(states=3, frequent=200, classes=64, rounds=4, unigram=0.0)
    packs, unigram, _ = hmm._encoded(documents(spark, SF), s, written)
    _, seen = hmm.train(packs.filter("not held_out"), unigram, s)
    assert seen[1] > seen[0] and all(b > a - 1e-4 * abs(a) for a, b in zip(seen, seen[1:]))


def brute_hmm(rows, s):
    """Scores by a plain Baum-Welch over Python lists, in double precision, one text and one place at a time."""
    learn = [lower(t or "") for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    split = lambda t: re.findall("[^ \t-\r]+", t)
    counts = Counter(w for t in learn for w in split(t))
    top = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: s.frequent])}
    symbol = lambda w: s.unknown if w not in counts else top[w] if w in top else hmm.word_class(w.encode(), s)
    shares = np.zeros(s.symbols)
    for w, c in counts.items():
        shares[symbol(w)] += c + 1
    shares[s.end], shares[s.unknown] = len(learn) + 1, 1
    unigram = shares / shares.sum()
    coded = lambda t: [*map(symbol, split(t)), s.end]
    model = hmm._first(s, unigram)
    for _ in range(s.rounds):
        at, moves, starts = np.zeros((s.symbols, s.states)), np.zeros((s.states, s.states)), np.zeros(s.states)
        for xs in map(coded, learn):
            alphas, betas = [], [np.ones(s.states)]
            for i, x in enumerate(xs):
                a = (alphas[-1] @ model.move if i else model.start) * model.emit[x]
                alphas.append(a / a.sum())
            for x in xs[:0:-1]:
                b = model.move @ (model.emit[x] * betas[0])
                betas.insert(0, b / b.sum())
            for i, x in enumerate(xs):
                g = alphas[i] * betas[i]
                at[x] += g / g.sum()
                starts += g / g.sum() if i == 0 else 0
                if i:
                    m = np.outer(alphas[i - 1], model.emit[x] * betas[i]) * model.move
                    moves += m / m.sum()
        model = hmm.Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), hmm._mixed(at, s, unigram))
    found = []
    for d, t in rows:
        logs, alpha = 0.0, None
        words = split(lower(t or ""))
        for x in (*map(symbol, words), s.end):
            a = (model.start if alpha is None else alpha @ model.move) * model.emit[x]
            logs, alpha = logs + math.log10(a.sum()), a / a.sum()
        found.append((d, logs + sum(math.log10((counts[w] + 1) / shares[symbol(w)]) for w in words if w in counts)))
    return found


def test_scores_are_those_of_a_plain_baum_welch(spark, odd):
    s = hmm.Settings(states=3, frequent=60, classes=16, rounds=2)
    for docs in (odd.filter("length(text) < 5000 or text is null"), documents(spark, SF).filter("length(text) < 3000")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        got, want = (sorted(x, key=key) for x in ([(r.doc_id, r.score) for r in hmm.score_documents(docs, s).collect()], brute_hmm(rows, s)))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4)


def test_blocks_and_packs_of_any_size_count_alike(spark, odd):
    docs = odd.select("doc_id", "text", (odd.doc_id % 3 == 0).alias("held_out")).fillna({"held_out": True})
    for sizes in ((1 << 20, 1000, 1 << 20), (200, 5, 7), (1, 1, 1)):
        rows = written(wordtable.coded(docs, hmm.words_of, len, *sizes), "coded")
        words = {(r.block, r["at"]): (r.word, r.c) for r in wordtable.counted(rows).collect()}
        want = Counter(w.decode() for r in docs.collect() if not r.held_out for w in hmm.words_of((r.text or "").encode()))
        texts = []
        for r in rows.filter("places is not null").collect():
            places = wordtable.unpacked(bytes(r.places), "<u4")
            for d, p in zip(r.doc_ids, np.split(places, np.cumsum(r.lengths)[:-1])):
                texts.append((d, " ".join(words[r.block, k][0] for k in p)))
        assert Counter(texts) == Counter((r.doc_id, b" ".join(hmm.words_of((r.text or "").encode())).decode()) for r in docs.collect())
        assert all(c == want[w] for w, c in words.values())


def brute_scan(text):
    words = [lower(w) for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))]
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_is_brute_force(odd, none, spark):
    more = ["mit license mit license MIT-License", "the gnu General Public License", "apache\nlicense", "MIT licenses", "mit", "Aémit license"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string")
    for docs in (odd.select("doc_id", "text").union(extra), documents(spark, SF)):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
        assert got == Counter((r.doc_id, *brute_scan(r.text)) for r in docs.collect())
    assert licenses.scan(none).count() == 0


def plain_text(template):
    """One text that the template stands for: optional parts in, first wordings, fillers of the least length allowed or three."""
    t = re.sub(r"<<one:((?:[^<>|]|<<var:\d+-\d+>>)*)(?:[^<>]|<<var:\d+-\d+>>)*>>", r"\1", re.sub(r"<<(opt|end)>>", "", template))
    return re.sub(r"<<var:(\d+)-(\d+)>>", lambda m: " ".join(["Jane"] * max(int(m[1]), min(int(m[2]), 3))) if m[2] != "1" else "", t)


def test_every_template_takes_its_text_and_no_other_wording():
    scan = licenses.Scanner()
    labels = lambda t: set(scan(t.encode())[5].split(","))
    draw = random.Random(12)
    for label, template in licenses.TEMPLATES.items():
        text = plain_text(template)
        found = labels("Some words before. " + text + ". Some after.")
        assert label in found, label
        assert sum(x.startswith("text:") for x in found) == label.startswith("text:"), (label, found)
        words, must = text.split(), licenses.mandatory_words(licenses.compile_template(template))
        first = [licenses.words_of(w.encode())[:1] for w in words]
        once = [i for i, w in enumerate(first) if w and w[0] in must and first.count(w) == 1]
        for k in draw.sample(once, min(6, len(once))):
            assert label not in labels(" ".join([*words[:k], "zzz", *words[k + 1 :]])), (label, words[k])


def test_templates():
    scan = licenses.Scanner()
    label = lambda t: scan(t.encode())[5]
    assert label("This work is licensed under the GNU General Public License, version 3.") == "gpl,notice:gpl-3.0"
    assert label("Licensed under the Apache License, Version 2.0.") == "apache,notice:apache-2.0"
    assert label("Released under the MIT License.") == "mit,notice:mit"
    assert label("Licensed under CC BY-NC 4.0.") == "notice:cc-by-nc-4.0"
    assert label("Licensed under the terms of the Apache License 2.0") == "apache,notice:apache-2.0"
    assert label("Licensed under an Apache License 2.0") == "apache"  # mandatory wording differs
    assert label("I like the MIT License") == "mit"
    mit = licenses.TEMPLATES["text:mit"]
    text = plain_text(mit)
    assert label(text) == "mit,text:mit" and label(text.replace("deal in", "trade in")) == "mit" and label(text.replace("WITHOUT WARRANTY", "WITH WARRANTY")) == "mit"


def test_automaton_accepts_what_a_regular_expression_accepts():
    a = licenses.compile_template("a <<opt>>b <<opt>>c<<end>><<end>> <<one:d e|f>> <<var:1-2>> g")
    rule = re.compile(r"a( b( c)?)? (d e|f)( \w){1,2} g")
    from itertools import product

    for n in range(3, 8):
        for words in product("abdefg", repeat=n) if n < 6 else [tuple("abcdexg"), tuple("abcfxg"), tuple("afxyg"), tuple("abdexyg")]:
            got = a.match([w.encode() for w in words], 0)
            want = max((len(m.split()) for k in range(1, len(words) + 1) if (m := " ".join(words[:k])) and rule.fullmatch(m)), default=None)
            assert got == want, words
    assert licenses.mandatory_words(a) == {b"a", b"g"}


def brute_quality(text):
    text = text or ""
    words = ASCII_SPACE.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if ASCII_SPACE.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base_is_brute_force(odd, none, spark):
    more = spark.createDataFrame([(1, "a b c d e " * 3, "en"), (2, "x y z u v\nx y z u v\n \nq", "en"), (3, "a a a a a a a a a a a a", None)], "doc_id bigint, text string, lang string")
    for docs in (odd.select("doc_id", "text", "lang").union(more), documents(spark, SF)):
        rows = quality.rate(docs).collect()
        got = Counter((r.doc_id, *(r.quality[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows)
        assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
        assert not any(r.quality.base_failed and r.quality.kept for r in rows)
    assert quality.rate(none.select("doc_id", "lang", "text")).count() == 0


def test_divergence_rejects_junk_and_keeps_prose(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good")
    rows = quality.rate(documents(spark, sf)).join(labels, "doc_id").select("quality.*", "good").collect()
    good = [r for r in rows if r.good == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    bad = [r for r in rows if r.good == 0 and not r.base_failed and r.word_distance is not None]
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad)


def test_distance():
    p, q = np.array([1.0, 0, 0]), np.array([0, 1.0, 1.0])
    assert quality.distance(p, p) == 0 and abs(quality.distance(p, q) - 1) < 1e-12


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert caught > 0.75 and wrong < 0.02, (caught, wrong)


def test_toxicity_finds_the_sentence_and_takes_odd_rows(spark, odd, none):
    good, bad = "the river runs. birds sing here. all is well.", "the river runs. you are a moron and scum. all is well."
    docs = spark.createDataFrame([(i, bad if i % 3 == 0 else good) for i in range(300)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "CAST(text LIKE '%moron%' AS int) AS toxic")
    row = toxicity.score(docs, labels).filter("doc_id = 0").first()
    assert row.predicted == 1 and bad[row.worst_start : row.worst_end].strip() == "you are a moron and scum"
    scored = toxicity.score(odd, labels)
    assert scored.count() == odd.count() and scored.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.score(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_toxicity_slope_is_the_loss_by_differences():
    draw = random.Random(4)
    found = [[[draw.randrange(9) for _ in range(draw.randrange(1, 4))] for _ in range(draw.randrange(1, 5))] for _ in range(30)]
    found = [[sorted(set(f)) for f in doc] for doc in found]
    toxic = np.array([draw.randrange(2) for _ in found])
    w, bias = np.array([draw.uniform(-1, 1) for _ in range(9)]), -0.7
    loss = toxicity.Loss(toxic, found, 9, 0.01)

    def brute(w, bias):
        total = 0.0
        for y, doc in zip(toxic, found):
            none = math.prod(1 - 1 / (1 + math.exp(-(bias + sum(w[i] for i in f)))) for f in doc)
            total -= math.log(1 - none if y else none)
        return total / len(toxic) + 0.01 * sum(x * x for x in w) / 2

    value, slope = loss(w, bias)
    assert abs(value - brute(w, bias)) < 1e-9
    for i in range(10):
        up, down = w.copy(), w.copy()
        ub = db = bias
        if i < 9:
            up[i], down[i] = w[i] + 1e-5, w[i] - 1e-5
        else:
            ub, db = bias + 1e-5, bias - 1e-5
        assert abs((brute(up, ub) - brute(down, db)) / 2e-5 - slope[i]) < 1e-6
    assert abs(toxicity.noisy_or([0.2, 0.5, 0.1]) - (1 - 0.8 * 0.5 * 0.9)) < 1e-12 and toxicity.noisy_or([0.0]) == 0


def test_toxicity_features_and_scores_are_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    s = toxicity.Settings(sample=400, features=60)
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").selectExpr("doc_id", "toxic", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").limit(400)
    rows = [(r.text or "", r.toxic) for r in docs.join(learn, "doc_id").collect()]
    bad, good = Counter(), Counter()
    for text, toxic in rows:
        (bad if toxic else good).update({f for w in re.findall(r"\w+", text.lower()) for f in [w + "$", *(w[:n] for n in range(3, 8) if len(w) >= n)]})
    base = sum(t for _, t in rows) / len(rows)
    z = {f: (bad[f] - base * (n := bad[f] + good[f])) / math.sqrt(n * base * (1 - base) + 1) for f in bad if bad[f] + good[f] >= 4 and 2 * bad[f] >= bad[f] + good[f]}
    want = sorted((f for f in z if z[f] > 3.5), key=lambda f: (-z[f], f))[:60]
    model = toxicity.fit(docs, labels, s)
    assert list(model.places) == want
    weights = dict(zip(model.places, model.weights))
    for r in toxicity.score(docs, labels, settings=s).join(docs, "doc_id").limit(300).collect():
        clear = 1.0
        for sentence in re.split(r"[.!?\n]+", r.text or ""):
            found = {f for w in re.findall(r"\w+", sentence.lower()) for f in toxicity.word_features(w, s)} & weights.keys()
            clear *= 1 - (1 / (1 + math.exp(-(model.bias + sum(weights[f] for f in found)))) if found else 0)
        assert abs(r.score - (1 - clear)) < 1e-6


def test_toxicity_ignores_other_labels_and_bounds_rows_of_repeated_ids(spark):
    texts = ["you moron", "a fine day", "moron again", "nice weather"] * 30
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN -1 ELSE CAST(text LIKE '%moron%' AS int) END AS toxic").distinct()
    s = toxicity.Settings(sample=20)
    a, b = (toxicity.fit(docs.repartition(n), labels, s) for n in (1, 5))
    assert a.places == b.places and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_quality_distances_and_verdict_are_brute_force(spark):
    docs = documents(spark, SF).selectExpr("doc_id", "lang", "text", "'own' AS quality")
    rows = docs.collect()
    kinds = lambda t: Counter("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c in "0123456789" else "blank" if c in " \t" else "line" if c in "\n\v\f\r" else "mark" if c in ".,;:!?'\"()-" else "ascii" if ord(c) < 128 else "other" for c in t)
    weigh = lambda t: Counter({k: n for k, n in kinds(t).items() if k != "other"}) + Counter({"other": sum(len(c.encode()) for c in t if ord(c) > 127)})
    spell = lambda t: [w.strip(".,;:!?'\"()-") for w in re.findall("[^ \t-\r]+", lower(t))]

    def js(a, b):
        p, q = ({k: n / max(1, sum(x.values())) for k, n in x.items()} for x in (a, b))
        half = lambda x, y: sum(v * math.log2(v / ((v + y.get(k, 0)) / 2)) for k, v in x.items() if v)
        return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    classes, words = {}, {}
    for r in rows:
        classes.setdefault(r.lang, Counter()).update(weigh(r.text))
        words.setdefault(r.lang, Counter()).update(spell(r.text))
    got = {r.doc_id: r.quality for r in quality.rate(docs).collect()}
    seen = Counter()
    for r in rows:
        q, own = got[r.doc_id], spell(r.text)
        top = sorted(words[r.lang], key=lambda w: (-words[r.lang][w], w.encode()))[:100]
        fold = lambda c: Counter({w: c[w] for w in top}) + Counter({None: sum(c.values()) - sum(c[w] for w in top)})
        by_class = js(weigh(r.text), classes[r.lang]) if len(r.text.encode()) >= 200 else None
        by_word = js(fold(Counter(own)), fold(words[r.lang])) if len(own) >= 50 else None
        for a, b in ((q.class_distance, by_class), (q.word_distance, by_word)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
        assert q.kept == (not q.base_failed and (by_class or 0) <= 0.30 and (by_word or 0) <= 0.52)
        seen[q.kept, q.base_failed] += 1
    assert min(seen[True, False], seen[False, False], seen[False, True]) > 0
