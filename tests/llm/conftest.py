import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, block string, kept boolean, word string, node int"


def odd_rows():
    """Nulls, empties, repeats, ties, long texts, odd characters; columns whose names the operators use inside."""
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "EPSILON.", "zeta", "x", "日本語", "naïve", "a|b", "**", "12"]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [make(n) for n in (1, 2, 3, 4, 5, 9, 10, 11, 40, 60, 200, 400)]
    texts += [None, "", " ", "\n\n", "\t x \x0b y \x0c z ", "one two three \x85 four", "tab\t  end \t ", "a  b   c \n\n d", "<|endoftext|> in  <|endoftext|>text", "é combining ́alone", "İstanbul ΣΑΣ ẞ", "😀😀 emoji 👩‍👩‍👧", "it's we'll I'D 'tis", "\x1c!\x1d sep"]
    texts += [make(30)] * 3 + [texts[8]] * 2 + [texts[10] + " omega", make(30000)]
    rows = [(i * 7 - 20, t, draw.choice(["en", "fr", None]), "s", None, "x", "y", None, "z", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[9], "en", None, 1, None, None, True, None, None), (None, None, None, None, None, None, None, None, None, None), rows[4], rows[4], (rows[5][0], "another text of that id", "en", "s", 3, "", "", False, "", 0)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
