import html
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundlake.llm import maintext, queries, spelling, whitening
from groundlake.llm.common import documents

SF = "/root/testdata/sf0.001"


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows):
    words = brute_words(rows)
    open_ = defaultdict(set)  # words that share a word with one letter left out, or one letter open, are candidates
    for w in words:
        for i in range(len(w)):
            open_[w[:i] + w[i + 1 :]].add(w)
        open_[w].add(w)
    near = defaultdict(set)
    for group in open_.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made_texts():
    draw = random.Random(3)
    rows, kinds = [], ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(7, 12))) for _ in range(60)]
    kinds += ["".join(draw.sample("abcdefg", 7)) for _ in range(300)]  # one vector
    for i in range(400):
        words = []
        for _ in range(draw.randrange(60)):
            w = kinds[min(draw.randrange(len(kinds)), draw.randrange(len(kinds)))]
            if draw.random() < 0.2:
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abÿ") + w[k:], w[:k] + draw.choice("abÿ") + w[k + 1 :]])
            words.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", ", ", "1", "-"]).join(words)))
    return rows


def test_variants_are_brute_force(spark, odd, none):
    made = made_texts()
    for docs in (odd, spark.createDataFrame(made, "doc_id bigint, text string"), documents(spark, "/root/testdata/sf0.01")):
        want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
        assert variants(spelling.variants(docs)) == want
    want = brute_variants(made)
    assert any(f for _, f, *_ in want) and any(k > 3 for *_, k, _ in want)
    assert spelling.variants(none).count() == 0


def test_variants_do_not_depend_on_the_cut_of_the_trie(spark, monkeypatch):
    docs = spark.createDataFrame(made_texts(), "doc_id bigint, text string").repartition(5)
    want = variants(spelling.variants(docs))
    assert want == variants(spelling.variants(docs, fragment=20))
    monkeypatch.setattr(spelling, "PAIRS", 50)
    words = [w.encode("latin-1") for w in brute_words(made_texts())]
    found = [tuple(sorted((words[i], words[j]))) for a, b in spelling.links(words, np.ones(len(words), dtype=bool)) for i, j in zip(a, b)]
    near = {tuple(sorted((a, b))) for k, a in enumerate(words) for b in words[:k] if one_edit(a.decode("latin-1"), b.decode("latin-1"))}
    assert len(found) == len(set(found)) and set(found) == near


def test_chains_of_forms_end_at_their_last(spark):
    made = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abclekji"]
    rows = [(1, " ".join(" ".join([w] * n) for w, n in zip(made, (2, 20, 200, 2000, 20000))))]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    while any(zlib.crc32(f"{rows[0][0]}:{w}".encode()) % 31 == 0 for w in made):  # an id under which no letter is left out
        rows = [(rows[0][0] + 1, rows[0][1])]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.word: r.root for r in spelling.variants(docs).collect()}
    assert found == dict.fromkeys(made, made[-1])


def brute_whiten(rows, components=4):
    """From exact fractions; only eigh and the last products are floating."""
    good = [(i, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(dims)]
    v = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(dims)] for i in range(dims)])
    values, axes = np.linalg.eigh(v)
    out = []
    for i, x in good:
        d = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for k in range(min(components, dims)):
            e = values[-1 - k]
            live = e > 1e-12 * values[-1]
            out.append((i, k + 1, n, d, abs(float((np.array(x) - np.array(s) / n) @ axes[:, -1 - k] / math.sqrt(e))) if live else None, e / np.trace(v)))
    return out


def same_whitening(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-6, abs=1e-7)


def whitened(df):
    rows = df.collect()
    assert all(r.identity_error is None or r.identity_error < 1e-6 for r in rows)
    return [(r.vec_id, r.component, r.n, int(r.deviation), None if r.whitened is None else abs(r.whitened), r.explained) for r in rows]


def test_whitening_is_brute_force(spark):
    draw = random.Random(4)
    mix = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    rows = []
    for i in range(200):
        z = [draw.gauss(0, 1) * (k + 1) for k in range(6)]
        rows.append((i, [sum(a * b for a, b in zip(z, m)) for m in mix]))
    rows += [rows[3], rows[3], (900, rows[3][1]), (None, rows[4][1]), (901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, [-0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"x": F.lit("clash"), "at": F.lit(1), "component": F.lit(0)}).repartition(3)
    same_whitening(whitened(whitening.whiten(df)), brute_whiten(rows))
    far = [(i, [c * 1e4 if k == 0 else c for k, c in enumerate(v)]) for i, v in rows[:60]]  # squares beyond 64 bits
    same_whitening(whitened(whitening.whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<float>"))), brute_whiten(far))
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    same_whitening(whitened(queries.op13_whitening(spark, SF)), brute_whiten([(r.vec_id, r.embedding) for r in table.limit(10**6).collect()]))


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None), (2, [math.nan])]).count() == 0
    one = make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect()
    assert [(r.component, r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, 1, None, None, None, 0), (1, 1, None, None, None, 0), (2, 1, None, None, None, 0), (2, 1, None, None, None, 0)] or sorted(r.component for r in one) == [1, 1, 2, 2]
    flat = make([(i, [float(i), 0.0, float(i)]) for i in range(5)]).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)} and flat[0].explained in (pytest.approx(1), pytest.approx(0))
    ragged = make([(1, [1.0]), (2, [1.0, 2.0]), (3, []), (4, [0.5, -1.0])]).collect()
    assert len(ragged) == 8 and {r.n for r in ragged} == {4}
    huge = make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.0])]).collect()
    assert len(huge) == 6 and all(r.whitened is None or math.isfinite(r.whitened) for r in huge)


def test_polarisation_gives_exact_covariances():
    draw = np.random.default_rng(5)
    z = draw.integers(-300, 300, (50, 7))
    pairs = {(i, j): int(s) for i, row in enumerate(whitening.squares(z)) for j, s in enumerate(row) if j >= i}
    v = whitening.covariance(50, z.sum(axis=0).tolist(), pairs)
    assert np.allclose(v, np.cov(z.T, bias=True), rtol=1e-13, atol=1e-9)
    assert (whitening.squares(z.astype(object)) == whitening.squares(z)).all()


ARTICLE = "<h1>On birds</h1><p>Birds, as a rule, fly &amp; sing;\n some don&#39;t.</p><p>A short one.<blockquote>Quoted, said.</blockquote><ul><li>first<li>second</ul><table><tr><td>a<td>b</table><p>Last&nbsp;<b>bo</b>ld<br>line."
MAIN = "On birds Birds, as a rule, fly & sing; some don't. A short one. Quoted, said. first second a b Last bold line."
JUNK = [
    '<nav><ul><li><a href="/a">Menu, one</a></ul></nav>', '<div class="ad">Buy, buy, buy, now, please, do, it, at, once.</div>', '<header><h2>Site, name</h2><p>Motto, of, it.</p></header>',
    '<aside><p>Beside, it, all, are, many, commas, here.</p></aside>', '<form><p>Your name, please</p><button>Go</button></form>', '<div id="comments"><p>First, nice, one!</p><p>Second, also, nice, really, one.</p></div>',
    '<section class="cookie-notice"><p>We use, as all, cookies.</p></section>', "<script>var t='</div><p>no, no</p>'; if (a<b) {}</script>", "<style>p{margin:0}</style>", "<!-- <p>hidden, away</p> -->",
    '<div class="left-sidebar"><ul><li><a href=x>Link, text</a></ul></div>', '<div role="navigation"><a href=a>x</a></div>', "<footer>&copy; all, rights</footer>", '<ol class="commentlist"><li>Me, too, as, well</ol>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class=text>{}</div></main>", '<div class="post-content">{}</div>', "<div><div>{}</div></div>"])
def test_article_stays_and_the_rest_goes(wrap):
    for seed in range(20):
        draw = random.Random(seed)
        before, after = draw.sample(JUNK, 4), draw.sample(JUNK, 4)
        page = "<!DOCTYPE html><html><head><title>T, t</title></head><body>" + "".join(before) + wrap.format(ARTICLE + draw.choice(JUNK[:2] + JUNK[4:10])) + "".join(after) + draw.choice(["</body></html>", ""])
        assert maintext.main_text(page) == MAIN, page


def test_paragraphs_without_tags_and_siblings():
    assert maintext.main_text("<div class='part'>One, two, three.<br><br>More of it.</div><div class='part'>Next, part.</div><div class=sidebar>a, b, c, d, e, f</div>") == "One, two, three. More of it. Next, part."
    assert maintext.main_text("plain, text &lt;only&gt;") == "plain, text <only>"
    assert maintext.main_text("<p>a <b>b<p>c</b> d") == "a b c d"
    assert maintext.main_text("<ul><li><a href=1>one, two</a><li><a href=2>three, four</a></ul>") == ""


def test_odd_pages_end_and_take_time_by_their_length():
    for piece in ("<", "<p", "<!--", "<div>", "</div>", "<a b='", '<a "', "<a<a", "<li>x", "<table><td>", "<script>", "&", "<![CDATA[", "<p><b><span></b>", "</", "<h1>"):
        maintext.main_text(piece * 20000)
    for seed in range(300):
        draw = random.Random(seed)
        maintext.main_text("".join(draw.choice(["<p>", "</p>", "<a href=x>", "</a>", "<div class='ad'>", "</div>", "<table>", "<td>", "</table>", "x, y", "<", "&amp", "<!--", "-->", "<h2>", "</h1>", "<li>", "</ul>", "<ul>", "<article>", "</article>"]) for _ in range(40)))


def test_pages_table(spark):
    rows = [(1, "u", "<p>One, two.</p>"), (1, "u", "<p>One, two.</p>"), (None, None, None), (2, "v", ""), (3, "w", "<article>" + "<p>word, word</p>" * 50000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(-1)})
    got = Counter(tuple(r) for r in maintext.extract(df).collect())
    assert got == Counter([(1, "u", "One, two.", 9)] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", " ".join(["word, word"] * 50000), 550000 - 1)])
    assert maintext.extract(df.limit(0)).count() == 0
    for r in queries.op11_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inside))
        assert (r.text, r.n_chars) == (want := " ".join(filter(None, blocks)), len(want)), json.dumps(r.page_id)
