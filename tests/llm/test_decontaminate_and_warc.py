import random
from collections import Counter, defaultdict

import pytest

from groundlake.llm import decontaminate, warc
from groundlake.llm.common import documents, open_input

SF = "/root/testdata/sf0.001"


def edits(pattern, text):
    """Fewest edits of all of ``pattern`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spoil(draw, text, n):
    out = list(text)
    for _ in range(n):
        k = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[k] = draw.choice("qwxz")
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, draw.choice("qwxz"))
    return "".join(out)


@pytest.mark.parametrize("segment,rate", [(60, 0.08), (40, 0.05)])
def test_patterns_find_what_brute_force_finds(segment, rate):
    draw = random.Random(segment)
    word = lambda: "".join(draw.choice(["th", "an", "er", "on", "re"]) for _ in range(draw.randrange(1, 5)))
    items = [(i, " ".join(word() for _ in range(draw.randrange(3, 30)))) for i in range(12)]
    patterns = decontaminate.Patterns(items, segment, rate)
    for trial in range(60):
        body = " ".join(word() for _ in range(60))
        item, text = draw.choice(items)
        cut = draw.randrange(len(body))
        body = decontaminate.normal(body[:cut] + " " + spoil(draw, text, draw.randrange(0, 8)) + " " + body[cut:])
        got = {f[0] for f in patterns.of(body)}
        want = {s[0] for s in patterns.segments if edits(s[2], body) <= s[3]} | {i for i, w in patterns.short if w in b" " + body + b" "}
        assert got == want, trial


def test_parameters_that_break_the_lemma_are_errors():
    item = [(1, "word " * 80)]
    for segment, rate in ((200, 0.08), (100, 0.2), (20, 0.2)):
        with pytest.raises(ValueError):
            decontaminate.Patterns(item, segment, rate)
    assert [s[3] for s in decontaminate.Patterns([(1, "fourteen bytes")], 100, 0.08).segments] == [0]


def test_banded_is_the_edit_distance():
    draw = random.Random(3)
    for _ in range(40):
        p = "".join(draw.choice("abcd") for _ in range(30))
        t = spoil(draw, p, draw.randrange(4))
        body = "xyz" + t + "zyx"
        got = decontaminate.banded(p.encode(), body.encode(), -2, 10, 6)
        assert got and got[0] == edits(p, body)


def test_long_texts_are_searched_whole(monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs through the dark green wood until it is home again at last"
    patterns = decontaminate.Patterns([(1, item)], 100, 0.08)
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    for lead in range(300, 1200, 37):
        assert patterns.of(decontaminate.normal("z" * lead + " " + item + " " + "y" * 700))


def test_leaks_on_documents(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, benchmark = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: decontaminate.normal(r.text) for r in benchmark.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in decontaminate.normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert len(whole) > 10 and whole <= got and len(got - whole) <= 2
    blocks = decontaminate.leaks(docs, benchmark, block_bytes=500)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    kept = decontaminate.drop_leaks(docs, benchmark, block_bytes=2000)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "  .. "), (4, "omega"), (5, "日本語")], "item_id bigint, text string")
    found = {r.item_id for r in decontaminate.leaks(odd, odd_items).collect()}
    assert found == {4, 5}
    twice = benchmark.limit(3).union(benchmark.limit(3)).union(spark.createDataFrame([(None, "alpha Beta gamma delta epsilon"), (None, "omega")], "item_id bigint, text string"))
    assert all(n % 2 == 0 for n in Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, twice).filter("item_id is not null").collect()).values())
    assert {r.item_id for r in decontaminate.leaks(odd, twice).collect()} == {None}
    assert decontaminate.leaks(none, benchmark).count() == 0 and decontaminate.leaks(odd, odd_items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, odd_items.limit(0)).count() == odd.count()


def brute_warc(rows):
    groups = defaultdict(list)
    for page_id, html in rows:
        groups[html or ""].append(page_id)
    out = Counter()
    for page_id, html in rows:
        payload = (html or "").encode()
        last = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = page_id != last
        out[page_id, len(payload), warc.payload_digest(payload), "revisit" if revisit else "response", last if revisit else None] += 1
    return out


def test_archives_hold_every_page(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nWARC-Type: evil", "<p>x</p>"), (3, None, None), (4, "http://ä/", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "u", "<p>x</p>"), (None, "v", "only"), (7, "u", "z" * 300000), (7, "u", "z" * 300000), (8, "u", "z" * 300000), (-9, "u", "neg")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, file string, ordinal int").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert got == brute_warc([(p, h) for p, _, h in rows])
    assert warc.archive(pages.limit(0)).count() == 0


def test_archives_of_the_table(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(pages.limit(40).selectExpr("page_id + 1000 AS page_id", "url", "html"))
    folder = f"file://{tmp_path}/w"
    rows = warc.archive(pages, folder).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == brute_warc([(p.page_id, p.html) for p in pages.collect()])
    index = spark.read.parquet(f"{folder}/index").collect()
    assert {r.record_type for r in index} == {"response", "revisit"}
    names = sorted({r.file for r in index})
    assert [x.name for x in sorted((tmp_path / "w/members").glob("*.gz"))] == [n.rsplit("/", 1)[1] for n in names]
    for name in names:  # the members one after another are one readable archive, and the text index names each
        with open_input(name) as f:
            held = [head["WARC-Type"] for head, _ in warc.Stream(f)]
        side = open(name[7:] + ".idx").read().splitlines()
        own = sorted((r.at, r.length, r.record_type) for r in index if r.file == name)
        assert held == [k for _, _, k in own] == [x.split()[3] for x in side] and [x.split()[0] for x in side] == [str(a) for a, _, _ in own]


def test_a_cut_stream_is_an_error(tmp_path):
    import zlib

    data = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = data.compress(warc.record(1, 0, "u", b"payload", warc.payload_digest(b"payload"))) + data.flush()
    p = tmp_path / "x.gz"
    p.write_bytes(whole)
    with open_input(f"file://{p}") as f:
        assert len(list(warc.Stream(f))) == 1
    cut = zlib.compressobj(1, zlib.DEFLATED, 31)
    p.write_bytes(cut.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc") + cut.flush())
    with pytest.raises(EOFError), open_input(f"file://{p}") as f:
        list(warc.Stream(f))
