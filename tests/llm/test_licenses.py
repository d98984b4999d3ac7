import re

import pytest

from quern.llm import licenses
from tests.llm.conftest import EDGES


def test_markup():
    a = licenses.Automaton("t", "one [[two [[three]]]] four {{x|0|2}} five")
    ok = lambda s: a.match(s.split(), 0) == len(s.split())
    assert all(map(ok, ["one four five", "one two four five", "one two three four five", "one four x five", "one four x y five"]))
    assert not any(map(ok, ["one three four five", "one four x y z five", "one two four", "one extra four five", "four five"]))
    with pytest.raises(ValueError):
        licenses.Automaton("t", "a [[b")
    with pytest.raises(ValueError):
        licenses.Automaton("t", "[[a]]")
    with pytest.raises(ValueError):
        licenses.Scanner({"t": "{{x|1|2}} a"})


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_automaton_against_regular_expression(name):
    """Automaton and expression agree on the template's own text, without its options, and with a word changed."""
    template = licenses.TEMPLATES[name]
    full = re.sub(r"\{\{[^|]*\|(\d+)\|\d+\}\}", lambda m: "some " * max(1, int(m.group(1))), template.replace("[[", "").replace("]]", ""))
    bare = template
    while "[[" in bare:
        bare = re.sub(r"\[\[[^\[\]]*\]\]", "", bare)
    bare = re.sub(r"\{\{[^|]*\|(\d+)\|\d+\}\}", lambda m: "some " * int(m.group(1)), bare)
    automaton, pattern = licenses.Automaton(name, template), re.compile(licenses.pattern(template))
    for text in (full, bare, "lead in " + bare + " and on"):
        words = licenses.WORD.findall(text.lower())
        starts = [i for i in range(len(words)) if automaton.match(words, i) > 0]
        assert starts and pattern.search("".join(f" {w} " for w in words))
        for k in range(len(words)):
            broken = words[:k] + ["broken"] + words[k + 1 :]
            hit = any(automaton.match(broken, i) > 0 for i in range(len(broken)))
            assert hit == bool(pattern.search("".join(f" {w} " for w in broken)))


def test_scan(spark, table):
    rows = [(1, "Foo. Released under the MIT License.\nReleased under the MIT License"), (2, "released under the new MIT License"), (3, "licensed under THE Apache License Version 2.0!"), (4, "licence plates"), *EDGES]
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["n_words"]) for r in licenses.scan(spark.read.parquet(table(rows))).collect())
    assert got == [(1, "MIT-notice", 1, 5), (1, "MIT-notice", 6, 5), (3, "Apache-2.0-notice", 0, 7)]
    assert licenses.scan(spark.read.parquet(table([]))).count() == 0
    assert licenses.scan(spark.read.parquet(table(rows)), {}).count() == 0


def test_every_notice_in_the_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r[0] for r in docs.where("text rlike '(?m)^(Released under the MIT License|Licensed under |This work is licensed under )'").select("doc_id").collect()}
    assert {r["doc_id"] for r in licenses.scan(docs).collect()} == want and want


@pytest.mark.parametrize("name", list(licenses.TEXTS))
def test_texts_with_and_without_a_word(name):
    """The wording with the fewest words for each region is found; without any one of its mandatory words it isn't."""
    bare = licenses.TEXTS[name]
    while "[[" in bare:
        bare = re.sub(r"\[\[[^\[\]]*\]\]", "", bare)
    parts = licenses.MARKUP.split(bare)
    words = [w for p in parts for w in (["some"] * int(p.split("|")[1]) if p.startswith("{{") else licenses.WORD.findall(p.lower()))]
    scanner = licenses.Scanner(licenses.TEMPLATES | licenses.TEXTS)
    found = lambda w: {n for n, *_ in scanner.scan(" ".join(w))}
    assert name in found(["lead", "in", *words, "and", "on"])
    assert not any(name in found(words[:k] + words[k + 1 :]) for k, w in enumerate(words) if w != "some")


def test_query_finds_licence_texts(spark, tmp_path):
    """Texts as they are usually written, through the query; ISC without its disclaimer is no ISC."""
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/."
    cc0 = "To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to Foo."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    rows = [(1, gpl), (2, mpl), (3, cc0), (4, isc), (5, gpl.replace("useful", "")), (6, gpl.replace("GNU General", "GNU Affero General"))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["license"]) for r in licenses.query(spark, str(tmp_path)).collect()}
    assert got == {(1, "GPL-header"), (2, "MPL-2.0-header"), (3, "CC0-1.0-notice"), (6, "AGPL-header")}
