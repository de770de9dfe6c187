"""License scans: base phrases, and templates with optional and replaceable regions compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: ASCII digits and letters (made lower case) and all bytes over 127 stay; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))

#: Fixed values of the base contract: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> template. <<opt>>..<<end>> may be absent; <<var:m-n>> stands for m to n words of any kind; <<one:a|b c>> for one
#: of the wordings given. All other wording is mandatory and must match word for word; case and punctuation don't count.
_GRANT = "<<one:licensed|released|distributed|available|provided>> under <<opt>>the terms of<<end>>"
TEMPLATES = {
    "notice:mit": f"{_GRANT} the <<opt>>expat<<end>> MIT license",
    "notice:apache-2.0": f"{_GRANT} the Apache License <<opt>>, <<end>><<opt>>Version<<end>> 2.0",
    "notice:gpl-2.0": f"{_GRANT} the <<opt>>GNU<<end>> General Public License <<opt>>, <<end>><<one:version 2|v2>> <<opt>>or <<one:later|any later version|at your option any later version>><<end>>",
    "notice:gpl-3.0": f"{_GRANT} the <<opt>>GNU<<end>> General Public License <<opt>>, <<end>><<one:version 3|v3>> <<opt>>or <<one:later|any later version|at your option any later version>><<end>>",
    "notice:cc-by-4.0": f"{_GRANT} <<opt>>a<<end>> <<one:CC BY|Creative Commons Attribution>> 4.0 <<opt>>International<<end>>",
    "notice:cc-by-sa-4.0": f"{_GRANT} <<opt>>a<<end>> <<one:CC BY-SA|Creative Commons Attribution-ShareAlike>> 4.0 <<opt>>International<<end>>",
    "notice:cc-by-nc-4.0": f"{_GRANT} <<opt>>a<<end>> <<one:CC BY-NC|Creative Commons Attribution-NonCommercial>> 4.0 <<opt>>International<<end>>",
    "notice:bsd-3-clause": f"{_GRANT} the <<one:BSD 3-Clause|3-clause BSD|new BSD|modified BSD>> license",
}

# Wording that several licenses share.
_AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE'''
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_ACTION = f"WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<var:0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<var:0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var:0-1>> Neither the <<one:name|names>> of <<var:1-12>> <<one:nor the names of its|nor the names of their|nor the names of|nor>> contributors may be used to
    endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = '''THIS SOFTWARE IS PROVIDED BY <<var:1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
    OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE'''
TEMPLATES |= {
    "text:mit": f"""<<opt>>The MIT License <<opt>>(MIT)<<end>><<end>> <<opt>>Copyright <<var:0-20>><<end>> Permission is hereby granted, free of charge, to any
        person obtaining a copy of <<one:this software|the software>> and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. {_AS_IS} AND
        <<one:noninfringement|non-infringement>>. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, {_ACTION}""",
    "text:isc": """<<opt>>ISC License<<end>> <<opt>>Copyright <<var:0-20>><<end>> Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND <<var:1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
        NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "text:bsd-2-clause": f"{_BSD_GRANT} {_BSD_END}",
    "text:bsd-3-clause": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_END}",
    "text:bsl-1.0": f"""<<opt>>Boost Software License <<opt>>Version 1.0 <<var:0-4>><<end>><<end>> Permission is hereby granted, free of charge, to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must
        be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the
        form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
        ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, {_DEALINGS}""",
    "text:unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
        benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, {_ACTION}""",
    "text:apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<one:this file|this work|these files>> except in
        compliance with the License. You may obtain a copy of the License at <<one:http|https>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License""",
    "text:mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at <<one:http|https>>://mozilla.org/MPL/2.0""",
}
_GNU = {"gpl": ("General Public License", ("2", "3")), "lgpl": ("<<one:Lesser|Library>> General Public License", ("2", "2.1", "3")), "agpl": ("Affero General Public License", ("3",))}
for _kind, (_name, _versions) in _GNU.items():
    for _version in _versions:
        for _end, _later in (("only", ""), ("or-later", ", or (at your option) any later version")):
            TEMPLATES[f"text:{_kind}-{_version}{'' if '.' in _version else '.0'}-{_end}-header"] = f"""<<one:This program|This library|This file|<<var:1-4>>>> is free software <<var:0-1>> you can
                redistribute it and/or modify it under the terms of the GNU {_name} as published by the Free Software Foundation <<opt>>, either<<end>> version {_version} of the
                License {_later}. <<one:This program|This library|This file|<<var:1-4>>>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
                the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {_name} for more details"""

_MARK = re.compile(r"<<(opt|end|var:\d+-\d+|one:(?:[^<>]|<<var:\d+-\d+>>)*)>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Word automaton: per state the moves on a word, the moves on any word, and the moves on nothing."""

    on: list[dict[bytes, set[int]]] = field(default_factory=list)
    any: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    accept: int = -1

    def state(self) -> int:
        self.on.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.on) - 1

    def spell(self, words: list[bytes], at: int) -> int:
        for w in words:
            new = self.state()
            self.on[at].setdefault(w, set()).add(new)
            at = new
        return at

    def reach(self, states: set[int]) -> frozenset[int]:
        open_, found = list(states), set(states)
        while open_:
            for s in self.free[open_.pop()] - found:
                found.add(s)
                open_.append(s)
        return frozenset(found)

    def wild(self, least: int, most: int, at: int) -> int:
        end = self.state()
        for i in range(most + 1):
            if i >= least:
                self.free[at].add(end)
            if i < most:
                new = self.state()
                self.any[at].add(new)
                at = new
        return end

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        return self.reach({t for s in states for t in (*self.on[s].get(word, ()), *self.any[s])})

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from ``start``."""
        states, end, i = self.reach({0}), None, start
        while states:
            if self.accept in states:
                end = i
            if i >= len(words):
                break
            states, i = self.step(states, words[i]), i + 1
        return end

    def first_words(self) -> set[bytes] | None:
        """Words that a match can begin with; None: any."""
        states = self.reach({0})
        return None if any(self.any[s] for s in states) else {w for s in states for w in self.on[s]}


def compile_template(template: str) -> Automaton:
    a = Automaton()
    at, opened, last = a.state(), [], 0
    for m in _MARK.finditer(template):
        at = a.spell(words_of(template[last : m.start()].encode()), at)
        last, kind = m.end(), m[1]
        if kind == "opt":
            opened.append(at)
            new = a.state()
            a.free[at].add(new)
            at = new
        elif kind == "end":
            new = a.state()
            a.free[at].add(new)
            a.free[opened.pop()].add(new)
            at = new
        elif kind.startswith("var:"):
            at = a.wild(*map(int, kind[4:].split("-")), at)
        else:
            end = a.state()
            for wording in kind[4:].split("|"):
                var = re.fullmatch(r"\s*<<var:(\d+)-(\d+)>>\s*", wording)
                here = a.state()
                a.free[at].add(here)
                a.free[a.wild(int(var[1]), int(var[2]), here) if var else a.spell(words_of(wording.encode()), here)].add(end)
            at = end
    if opened:
        raise ValueError("an optional region isn't closed")
    a.accept = a.spell(words_of(template[last:].encode()), at)
    return a


def mandatory_words(a: Automaton) -> set[bytes]:
    """Words without which no run is accepted."""
    words, open_ = {s: None for s in range(len(a.on))}, [0]  # words met on every way to a state; None: no way found yet
    words[0] = frozenset()
    while open_:
        s = open_.pop()
        for t, w in [*((t, None) for t in (*a.free[s], *a.any[s])), *((t, w) for w, ts in a.on[s].items() for t in ts)]:
            new = words[s] if w is None else words[s] | {w}
            kept = new if words[t] is None else words[t] & new
            if kept != words[t]:
                words[t] = kept
                open_.append(t)
    return set(words[a.accept] or ())


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = []
        for label, text in templates.items():
            a = compile_template(text)
            must = mandatory_words(a)
            key = max(sorted(must), key=len) if must else None
            self.automata.append((label, a, key and b" " + key + b" ", a.first_words()))

    def __call__(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans as (label, first word, end word)."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(line.count(b" ", 0, at))
                base.add(label)
                at = line.find(phrase, at + 1)
        spans = []
        for label, a, key, firsts in self.automata:
            if key is not None and key not in line:
                continue
            i = 0
            while i < len(words):
                end = a.match(words, i) if firsts is None or words[i] in firsts else None
                if end is not None and end > i:
                    spans.append((label, i, end))
                    i = end
                else:
                    i += 1
        labels = base | {label for label, _, _ in spans}
        score = 1.0 if spans else 0.5 if places else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row of ``docs`` (doc_id, text).

    Templates are short notices, whole texts with their disclaimers (MIT, ISC, BSD, BSL, Unlicense) and the headers that
    files carry for longer licenses (Apache, MPL, GNU); a text whose disclaimer differs has no such label.

    Base: every place where a phrase's words stand in a row. Templates add their labels where an
    automaton accepts a run of words; score is 1 for an accepted template, 0.5 for a base phrase alone, else 0.
    No label gives the empty string. Null and empty texts have no words. Repeated rows are scanned each;
    other columns are ignored; very long texts are scanned whole; no rows give none. Of matches of one template that
    overlap the first counts, at its longest. One pass without a shuffle; only the templates are sent out.
    """
    found = templates or TEMPLATES
    kind = "struct<n_words:bigint, n_base:bigint, first_word:bigint, last_word:bigint, base_labels:string, labels:string, score:double, spans:array<struct<label:string, first:bigint, end:bigint>>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(found)
        yield from (scanned(scanner, texts) for texts in batches)

    def scanned(scanner: Scanner, texts: pa.Array) -> pa.Array:
        rows = [(*r[:7], [dict(zip(("label", "first", "end"), x)) for x in r[7]]) for r in map(scanner, text_bytes(texts))]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    return docs.select("doc_id", run.asNondeterministic()(F.col("text")).alias("s")).select("doc_id", "s.*")
