import random

import pyarrow.parquet as pq
import pytest
from test_decontaminate_and_warc import spoil

from groundlake.llm import decontaminate

SF = "/root/testdata/sf0.1"


def quotes(draw, length):
    """Random parts of ``length`` bytes of the benchmark's items, set into other prose."""
    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in rows]
    word = lambda: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randrange(1, 4)))
    for item, text in items:
        body = decontaminate.normal(text).decode("utf-8", "ignore")
        if body.isascii() and len(body) > length:
            at = draw.randrange(len(body) - length + 1)
            prose = " ".join(word() for _ in range(80))
            cut = draw.randrange(len(prose))
            yield item, body[at : at + length], prose[:cut] + " ", " " + prose[cut:]


@pytest.mark.parametrize("length", [90, 120, 150, 180])
def test_verbatim_quotes_are_found_at_any_offset(length):
    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    patterns = decontaminate.Patterns([(r["item_id"], r["text"]) for r in rows], 100, 0.08)
    draw, n = random.Random(length), 0
    for _ in range(2):
        for item, quote, head, tail in quotes(draw, length):
            found = {f[0]: f for f in patterns.of(decontaminate.normal(head + quote + tail))}
            assert item in found and found[item][3] == 0, (item, quote)
            n += 1
    assert n > 50


def test_edited_quotes_are_found_at_any_offset():
    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    patterns = decontaminate.Patterns([(r["item_id"], r["text"]) for r in rows], 100, 0.08)
    draw, n = random.Random(4), 0
    for item, quote, head, tail in quotes(draw, 120):
        body = decontaminate.normal(head + spoil(draw, quote, 4) + tail)
        assert item in {f[0] for f in patterns.of(body)}, (item, quote)
        assert item not in {f[0] for f in patterns.of(decontaminate.normal(head + tail))}
        n += 1
    assert n > 25
