import re
import time
from html.parser import HTMLParser

from quern.llm import html

P = "The cat and the dog are in the house and it is not that the one who has it was there before all of this was to be. " * 3


def test_two_passes():
    page = f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><h1>A title</h1><p>{P}</p><p>Short one.</p><p>{P}</p><div><a href='x'>one</a> <a href='y'>two</a></div><p>Tail.</p><footer>&copy; me</footer></body></html>"
    text, n, kept = html.extract_text(page)
    assert "Short one." in text and "Home" not in text and "Tail." not in text and "©" not in text and text.count("The cat") == 6
    assert n == 8 and kept in (3, 4)


def test_second_pass():
    g, n, s, b = html.GOOD, html.NEAR, html.SHORT, html.BAD
    assert html.second_pass([b, s, s, g]) == [False, False, True, True]
    assert html.second_pass([b, s, g]) == [False, False, True]
    assert html.second_pass([g, s, g, n, b]) == [True, True, True, True, False]
    assert html.second_pass([b, n, b]) == [False, False, False]
    assert html.second_pass([s, g, s]) == [True, True, True]
    assert html.second_pass([s, b, s]) == [False, False, False]
    assert html.second_pass([s, n]) == [False, True]
    assert html.second_pass([]) == []


def test_markup_that_is_broken():
    assert html.blocks("a < b and <p>c <!-- x <p>d</p> --> e<script>if (a<b) '</p>'</script>f") == [("a < b and", 0), ("c e", 0), ("f", 0)]
    assert html.blocks("<p title='>'>x &amp; y</p><p>z") == [("x & y", 0), ("z", 0)]
    assert html.blocks("x<!-- never closed <p>y</p>") == [("x", 0)]
    assert html.blocks("<a href=q>link <b>text</b></a> rest") == [("link text rest", 8)]
    assert html.blocks("<p title=it's>one</p><p>it's two</p>") == [("one", 0), ("it's two", 0)]
    assert html.blocks("<SCRIPT>x</Script >one<p title=\"a") == [('one<p title="a', 0)]
    assert html.blocks("one<style>x") == [("one", 0)]


def test_no_page_is_lost():
    """Forms, unclosed navigation, options and other languages leave the text of the page alone."""
    three = f"<p>{P}</p>" * 3
    for page in (f"<form>{three}</form>", f"<nav><a href=q>x</a>{three}", f"<select><option>A<option>B</select>{three}", f"<select><option>A{three}", f"<header>{three}</header>"):
        assert html.extract_text(page)[0].count(P.strip()) == 3, page[:20]
    it = "Il gatto e il cane sono nella casa, e non è vero che quello che ha parlato prima di noi fosse già lì con la sua famiglia per tutto il giorno. " * 2
    ru = "Кошка и собака были в доме, и это не то, что он сказал нам, когда мы пришли к ним, чтобы поговорить о том, что было с ними. " * 2
    fi = "Kissa ja koira olivat talossa eikä kukaan tiennyt mistä naapurin vanha auto oli tullut pihalle viime yönä sateen aikana. " * 2
    for t in (it, ru, fi):
        assert html.extract_text(f"<p>{t}</p>" * 3)[2] == 3
    assert html.extract_text(f"<p>{P} © {P}</p>")[2] == 1 and html.extract_text(f"<p>{P}</p><p>© the owners of it all, who are the ones that have it and more</p>")[2] == 1


def test_hostile_markup_takes_linear_time():
    begin = time.time()
    for part in ("<script", "<a b='", '<a b="', "<!-", "<p ", "<select>", "<", "</", "<a =" + " " * 50 + "'", "<style><p>"):
        html.extract_text(part * (2_000_000 // len(part)))
    assert time.time() - begin < 20


class Plain(HTMLParser):
    """Text blocks by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.parts, self.skip = [], [], 0

    def end(self):
        t = " ".join("".join(self.parts).split())
        if t:
            self.out.append(t)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "noscript", "template"):
            self.end()
            self.skip += 1
        elif tag not in html._INLINE:
            self.end()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag not in html._INLINE:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_blocks_against_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        p = Plain()
        p.feed(r["html"])
        p.end()
        assert [b[0] for b in html.blocks(r["html"])] == p.out


def brute(found, p):
    """Both passes, each rule by itself: texts kept."""
    page = " ".join(t.lower() for t, _ in found)
    every = re.findall(r"\w+", page)
    lists = [(sum(w in v for w in every), -i, v) for i, v in enumerate(html.STOP.values())]
    most, _, stop = max(lists, key=lambda x: x[:2])
    listed = bool(every) and most / len(every) >= p["known"]
    label = []
    for t, links in found:
        w = re.findall(r"\w+", t.lower())
        sentence = re.search(r"[.!?…。！？।؟][\"'»”)]*$", t) and 4 * len(set(w)) >= len(w) and 10 * sum(t.count(x) for x in "|•·>/") <= len(w)
        dense = sum(x in stop for x in w) / max(1, len(w)) if listed else float(bool(sentence))
        if links / len(t) > p["max_links"] or ("©" in t and len(t) <= p["long"]):
            label.append("-")
        elif len(t) < p["short"]:
            label.append("-" if links else "s")
        elif dense < p["stop_low"]:
            label.append("-")
        else:
            label.append("+" if dense >= p["stop_high"] and len(t) > p["long"] else "n")
    kept = []
    for i, x in enumerate(label):
        left = next(((i - j, label[j]) for j in range(i - 1, -1, -1) if label[j] in "+-"), None)
        right = next(((j - i, label[j]) for j in range(i + 1, len(label)) if label[j] in "+-"), None)
        around = [y for y in (left, right) if y]
        if x == "n":
            good = not around or any(y[1] == "+" for y in around)
        elif x == "s":
            near = [y[1] for y in around if y[0] == min(z[0] for z in around)]
            good = bool(near) and set(near) == {"+"}
        else:
            good = x == "+"
        if good:
            kept.append(found[i][0])
    return kept


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in html.query(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        p = Plain()
        p.feed(r["html"])
        p.end()
        # the parser's blocks, with the characters in links from ours
        found = list(zip(p.out, [n for _, n in html.blocks(r["html"])], strict=True))
        kept = brute(found, html.PARAMS)
        assert got[r["page_id"]]["text"] == "\n".join(kept) and got[r["page_id"]]["n_kept"] == len(kept)
    assert sum(r["n_kept"] > 0 for r in got.values()) > 0.9 * len(got)


def test_frame(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "v", "<br>", 3), (3, "w", f"<p>{P}</p>", 4), (3, "w", f"<p>{P}</p>", 4)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((str(r["page_id"]), r["n_blocks"], r["n_kept"]) for r in got) == [("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("None", 0, 0)]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    long = html.extract_text(f"<div>{P * 5000}</div>")
    assert len(long[0]) > 1_500_000
