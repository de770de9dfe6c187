"""Byte-pair encoding with files of the tokenizers library: words that encode alone, a cache of them, pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

#: A run of white space with the word after it. A cut lies between a non-space and a blank or newline only, where no
#: token of a byte-level vocabulary can reach across; other white space stays inside its chunk.
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*$)?|\s+")
#: In a text without these, white space is single blanks and newlines.
_ODD = ("  ", "\n\n", " \n", "\n ", *map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
AS_IS = "\0"


def byte_level_words(text: str) -> list[str]:
    """Words of a text for a byte-level vocabulary. A word stands for itself with a blank before it; one that starts with
    a newline, or with the mark AS_IS, for itself (without the mark)."""
    if any(x in text for x in _ODD):
        return [AS_IS + c for c in _CHUNK.findall(text)]
    if not text:
        return []
    words = text.replace("\n", " \n").split(" ")
    if words[0][:1] != "\n":
        words[0] = AS_IS + words[0] if words[0] else ""
        if not words[0]:
            del words[0]
    return words


def spelled(word: str) -> str:
    return word[1:] if word[:1] == AS_IS else word if word[:1] == "\n" else " " + word


def lone_words(text: str) -> list[str]:
    """Words for vocabularies that drop white space."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_all(tokenizer, words: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class WordCache:
    """What ``make(words)`` says of each word, kept in two generations of at most ``limit`` words each.

    ``fixed`` holds words whose value is known from the start; they are never dropped.
    """

    def __init__(self, make: Callable[[list[str]], list], fixed: dict | None = None, limit: int = 200_000):
        self.make, self.fixed, self.limit = make, fixed or {}, limit
        self.known, self.old = dict(self.fixed), {}

    def __call__(self, texts: list[list[str]]) -> Iterator[Iterator]:
        """For each text, the values of its words in order."""
        if len(self.known) > self.limit + len(self.fixed):
            self.known, self.old = dict(self.fixed), self.known
        known, old, new = self.known, self.old, {}
        for words in texts:
            for w in words:
                if w not in known:
                    if w in old:
                        known[w] = old[w]
                    else:
                        new[w] = None
        if new:
            known.update(zip(new, self.make(list(new))))
        return (map(known.__getitem__, words) for words in texts)


_KEPT: dict[tuple, WordCache] = {}


def kept_cache(key: tuple, build: Callable[[], WordCache]) -> WordCache:
    """One cache for all tasks that a Python worker runs: the next task meets most of the words of the last."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def byte_pieces(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of a byte-level vocabulary; added tokens stand for their own text."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown, spare = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            shown[chr(spare)], spare = b, spare + 1
    tokenizer = load(path)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    return [(i, added[i].encode() if i in added else bytes(shown[c] for c in piece)) for piece, i in tokenizer.get_vocab(with_added_tokens=True).items()]
