"""Licence scans by matching templates with markup.

A template is mandatory wording with ``[[optional wording]]``, which may nest, and ``{{name|least|most}}``, a region that may be replaced by
``least`` to ``most`` words of any kind. Texts and templates are compared as words: runs of letters, digits and
underscores, lower-cased, and dots within numbers; white space and punctuation don't count. Templates are compiled into token automata; a licence is found where an automaton
accepts a run of words, all mandatory words present, in order, and with no word between them that no region allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

WORD = re.compile(r"\w+(?:\.\w+)*")
TEMPLATES = {
    "MIT-notice": "[[This {{work|1|3}} is]] [[released]] [[licensed]] under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        {{holders|1|8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-notice": "licensed under the [[terms of the]] GNU General Public License, [[as published by the Free Software Foundation]] [[either]] version {{version|1|1}} [[or later]] [[of the License]]",
    "LGPL-notice": "licensed under the [[terms of the]] GNU Lesser General Public License [[either]] version {{version|1|1}}",
    "CC-notice": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY [[NC]] [[SA]] [[ND]] {{version|1|1}}",
    "BSD-notice": "Licensed under the [[{{kind|1|2}}]] BSD License",
    "ISC": """Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: {{mark|0|1}} Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. {{mark|0|1}} Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ {{mark|0|1}} Neither the name of {{holder|1|12}} nor the names of {{its|1|2}} contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY {{holders|1|12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        {{holders|1|12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_GNU = """is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as
        published by the Free Software Foundation[[,]] [[either]] version {{{{version|1|1}}}} of the License [[, or (at your option) any later version]].
        {{{{name|1|6}}}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details"""
#: What the query looks for beside TEMPLATES, which its SQL is made from; of one name, the template here is the one used.
TEXTS = {
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END,
    "GPL-header": _GNU.format(kind=""),
    "LGPL-header": _GNU.format(kind="Lesser"),
    "AGPL-header": _GNU.format(kind="Affero"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at {{scheme|1|1}}://mozilla.org/MPL/2.0""",
    "CC0-1.0-notice": "To the extent possible under law, {{person|1|12}} waived all copyright and related or neighboring rights to",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "ISC": TEMPLATES["ISC"] + """. THE SOFTWARE IS PROVIDED "AS IS" AND {{author|1|8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{author|1|8}} BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
}
MARKUP = re.compile(r"(\[\[|\]\]|\{\{[^|{}]*\|\d+\|\d+\}\})")


class Automaton:
    """Token automaton of a template. step[state]: word -> states; free[state]: states after any word; empty moves are resolved."""

    def __init__(self, name: str, template: str):
        self.name = name
        self.step: list[dict[str, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        at, opened = 0, []
        for part in MARKUP.split(template):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.empty[opened.pop()].append(at)
            elif part.startswith("{{"):
                least, most = (int(x) for x in part[2:-2].split("|")[1:])
                ends = [at] if least == 0 else []
                for k in range(1, most + 1):
                    new = self._state()
                    self.free[at].append(new)
                    at = new
                    if k >= least:
                        ends.append(at)
                for e in ends[:-1]:
                    self.empty[e].append(at)
            else:
                for w in WORD.findall(part.lower()):
                    new = self._state()
                    self.step[at].setdefault(w, []).append(new)
                    at = new
                    if not opened:
                        self.mandatory.append(w)
        if opened:
            raise ValueError(f"{name}: optional wording isn't closed")
        if not self.mandatory:
            raise ValueError(f"{name}: no mandatory wording")
        self.end = at
        self.closed = [self._closure(i) for i in range(len(self.step))]
        self.first = {w for s in self.closed[0] for w in self.step[s]}
        self.open_start = any(self.free[s] for s in self.closed[0])

    def _state(self) -> int:
        self.step.append({})
        self.free.append([])
        self.empty.append([])
        return len(self.step) - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int:
        """End of the longest accepted run of words from ``at``, or -1."""
        states, best = self.closed[0], -1
        for i in range(at, len(words)):
            if self.end in states:
                best = i
            new: set[int] = set()
            for s in states:
                for t in self.step[s].get(words[i], ()):
                    new |= self.closed[t]
                for t in self.free[s]:
                    new |= self.closed[t]
            if not new:
                return best
            states = new
        return len(words) if self.end in states else best


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.automata = [Automaton(n, t) for n, t in templates.items()]
        if any(a.open_start for a in self.automata):
            raise ValueError("a template may not begin with a replaceable region")
        self.begin: dict[str, list[int]] = {}
        for i, a in enumerate(self.automata):
            for w in a.first:
                self.begin.setdefault(w, []).append(i)
        #: Every text with a match holds the words of one of these; a text without them needn't be scanned.
        self.anchors = sorted({max(a.mandatory, key=lambda w: (len(w), w)) for a in self.automata})

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, first word, last word + 1), in each licence's matches leftmost and longest, not overlapping."""
        words = WORD.findall(text.lower())
        free, out = [0] * len(self.automata), []
        for at, w in enumerate(words):
            for i in self.begin.get(w, ()):
                if at >= free[i] and (end := self.automata[i].match(words, at)) > at:
                    free[i] = end
                    out.append((self.automata[i].name, at, end))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, n_words) of every match in every row of ``docs``. Words count from 0.

    Texts that lack a mandatory word of every template are passed over inside the JVM; they can't match. Null and empty
    texts match nothing. Matches of different licences may overlap; those of one licence don't: the leftmost is taken, of those from one word
    the longest. Repeated rows and null doc_ids give rows of their own; other columns are ignored. An empty table gives no
    rows, and so do no templates. Whole texts of any length are scanned. One narrow stage: no shuffle.
    """
    scanner = Scanner(TEMPLATES | TEXTS if templates is None else templates)
    hit = F.lit(False)
    for w in scanner.anchors:
        hit = hit | F.contains(F.col("quern_low"), F.lit(w))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lower("text").alias("quern_low")).where(hit).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            found = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in scanner.scan(t)]
            ids, names, first, end = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "license": pa.array(names, pa.string()), "first_word": pa.array(first, pa.int64()), "n_words": pa.array([e - f for f, e in zip(first, end, strict=True)], pa.int64())})

    return rows.mapInArrow(run, "doc_id bigint, license string, first_word bigint, n_words bigint")


def pattern(template: str) -> str:
    """The template as a regular expression over words that are framed by a space on either side each."""
    out = ""
    for part in MARKUP.split(template):
        if part == "[[":
            out += "(?:"
        elif part == "]]":
            out += ")?"
        elif part.startswith("{{"):
            least, most = part[2:-2].split("|")[1:]
            out += f"(?: [^ ]+ ){{{least},{most}}}"
        else:
            out += "".join(f" {re.escape(w)} " for w in WORD.findall(part.lower()))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    each = " union all ".join(f"""select doc_id, '{name}' as license, regexp_extract_all(framed, '{pattern(t)}') as hits, string_split_regex(framed, '{pattern(t)}') as rest from f where regexp_matches(framed, '{pattern(t)}')""" for name, t in TEMPLATES.items())
    count = "len(regexp_extract_all({}, ' [^ ]+ '))"
    return f"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+(?:\\.[\\pL\\pN_]+)*') as w from documents),
f as (select doc_id, ' ' || array_to_string(w, '  ') || ' ' as framed from w where len(w) > 0),
m as ({each}),
k as (select doc_id, license, unnest(range(1, len(hits) + 1)) as i, list_transform(hits, lambda x: {count.format("x")}) as h, list_transform(rest, lambda x: {count.format("x")}) as r from m)
select doc_id, license, (list_sum(r[1:i]) + coalesce(list_sum(h[1:i - 1]), 0))::bigint as first_word, h[i]::bigint as n_words from k"""


SQL = _sql()
