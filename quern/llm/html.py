"""Main text of web pages by two-pass block rules.

Pages are cut into blocks at block-level tags. First pass, each block alone: by its length, its share of stop words and its share
of text in links it is good, nearly good, short or bad. Second pass: short and nearly good blocks take the label of the
nearest blocks that were decided. Good blocks make up the text.

Stop words are those of the page's language: the list of ``STOP`` that has the most of the page's words. Where even that has less
than ``known`` of them, the language has no list; running prose, told by its marks, then counts as dense in stop words. Tags only cut blocks: which
elements a block is in doesn't count, but for options of a closed ``<select>``, which aren't text of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production: characters of a short and of a long block; shares of stop words; share of characters in links;
#: share of stop words from which a page's language is known.
PARAMS = {"short": 60, "long": 180, "stop_low": 0.12, "stop_high": 0.2, "max_links": 0.25, "known": 0.1}
STOP = {
    "en": "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its more my no not of on one or other our out she so some than that the their them there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur",
    "es": "a al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me muy no nos o para pero por que se según ser si sin sobre son su sus también te un una y ya",
    "fr": "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta te tes ton tu un une vos votre vous",
    "it": "a ad ai al alla alle anche che chi ci come con cui da dal dalla dei del della delle di dove e ed era gli ha hanno i il in io la le lei lo loro lui ma mi nel nella noi non o per perché più quale quando quello questa questo se si sono su sua sulla suo tra un una uno",
    "pt": "a ao aos as até com como da das de do dos e ela ele em entre era essa esse esta este eu foi há isso já lhe mais mas me muito na nas nem no nos não o os ou para pela pelo por qual quando que se sem ser seu sua são também te um uma",
    "nl": "aan al als ook bij dan dat de der die dit door een en er had heb heeft het hij hoe ik in is je kan maar me meer met mijn na naar niet nog nu of om omdat onder ons op over te tot uit van veel voor was wat we werd wie wij ze zich zij zijn zo",
    "pl": "a aby ale bardzo bez był była było być co czy dla do gdy go i ich ile im ja jak jako je jest jego jej już która które który lub ma mnie na nad nas nie niż o od oraz po pod przez przy się są ta tak tego tej ten to tu tylko w we więc z za ze że",
    "sv": "alla att av blev bli de dem den denna deras det detta dig din du där efter ej eller en ett från för ha hade han har hans hon i icke in inte jag ju kan man med men mig mot mycket ni nu när och om oss på sedan sig sin ska som så till under upp ut vad var vi vid är",
    "ru": "а без более бы был была были было быть в вам вас во вот все всё вы где да даже для до его ее её если есть еще же за и из или им их к как когда кто ли мы на над не него нет ни но о об он она они от по под при с со так также там то только том ты у уже чем что чтобы эта эти это я",
}
STOP = {lang: frozenset(words.split()) for lang, words in STOP.items()}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content isn't text of the page; without an end tag they reach to its end.
_HIDDEN = frozenset("script style noscript template svg iframe head".split())
_END_TAGS = {f"</{name}": re.compile(f"</{name}", re.I | re.A) for name in (*_HIDDEN, "select")}
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_IN_TAG = re.compile(r"""[>"']""")
_EQUALS = re.compile(r"=\s*\Z")
_BARS = re.compile(r"[|•·>/]")
_SPACE = re.compile(r"\s+")
GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


class _Page:
    """Finds marks in a page in linear time: what wasn't found from one place isn't looked for again from a later one."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        if what.startswith("</"):
            m = _END_TAGS[what].search(self.html, at)
            found = m.start() if m else -1
        else:
            found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """After the '>' of the tag whose name ends at ``at``; quoted values may hold any mark. -1 if nothing closes it."""
        if self.find(">", at) < 0:
            return -1
        while m := _IN_TAG.search(self.html, at):
            if m.group() == ">":
                return m.end()
            # a quote counts after '='; looking back over the blanks between them
            close = self.find(m.group(), m.end()) if _EQUALS.search(self.html, max(at, m.start() - 64), m.start()) else -1
            at = close + 1 if close >= 0 else m.end()
        return -1


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, characters in links) of each non-empty block, in order."""
    page = _Page(html)
    out, parts = [], []
    links, at, text_from, options_to = 0, 0, 0, -1
    inside_link = False

    def add(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if inside_link:
                links += len(_SPACE.sub(" ", unescape(text)).strip())

    def end() -> None:
        nonlocal links
        text = _SPACE.sub(" ", unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append((text, links))
        parts.clear()
        links = 0

    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            after = page.find("-->", at + 4)
            add(html[text_from:at])
            at = text_from = after + 3 if after >= 0 else len(html)
            continue
        m = _NAME.match(html, at + 1)
        if not m:
            after = page.find(">", at)
            # other declarations and stray marks
            if after >= 0 and html[at + 1 : at + 2] in ("!", "?", "/"):
                add(html[text_from:at])
                at = text_from = after + 1
            else:
                at += 1
            continue
        after = page.tag_end(m.end())
        if after < 0:
            at += 1
            continue
        add(html[text_from:at])
        name, closing = m.group().lstrip("/").lower(), m.group()[0] == "/"
        at = text_from = after
        if name in _INLINE:
            if name == "a":
                inside_link = not closing
            continue
        end()
        if name in _HIDDEN and not closing:
            close = page.find(f"</{name}", at)
            stop = page.find(">", close) if close >= 0 else -1
            at = text_from = stop + 1 if stop >= 0 else len(html)
        elif name == "select" and not closing and at > options_to:
            options_to = page.find("</select", at)
            if options_to >= 0:
                at = text_from = options_to
    add(html[text_from:])
    end()
    return out


def stop_words(texts: list[list[str]], known: float) -> frozenset[str] | None:
    """The list with the most of a page's words, the first of ``STOP`` in a tie; None where that is under ``known`` of them."""
    times: Counter = Counter()
    for t in texts:
        times.update(t)
    hits = {lang: sum(map(times.__getitem__, stop & times.keys())) for lang, stop in STOP.items()}
    best = max(hits, key=hits.get)
    return STOP[best] if times and hits[best] >= known * times.total() else None


def prose(text: str, words: list[str]) -> bool:
    """Whether a block of an unknown language ends a sentence, isn't made up of a few words, and isn't a list cut by bars or dots."""
    return text.rstrip("\"'»”)")[-1:] in tuple(".!?…。！？।؟") and len(set(words)) * 4 >= len(words) and len(_BARS.findall(text)) * 10 <= len(words)


def first_pass(text: str, links: int, words: list[str], stop: frozenset[str] | None, p: dict) -> str:
    n = len(text)
    if links > p["max_links"] * n or ("©" in text and n <= p["long"]):
        return BAD
    if n < p["short"]:
        return BAD if links else SHORT
    share = (p["stop_high"] if prose(text, words) else 0.0) if stop is None else sum(map(stop.__contains__, words)) / len(words) if words else 0.0
    if share >= p["stop_high"]:
        return GOOD if n > p["long"] else NEAR
    return NEAR if share >= p["stop_low"] else BAD


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block is kept. An undecided block takes the label of the nearest decided one; at equal distance both must be good.

    A nearly good block takes good over bad whatever the distance; beyond the page's ends there is nothing. With no
    decided block on the page, nearly good ones are kept and short ones aren't.
    """
    n = len(labels)
    before, after = [-1] * n, [n] * n
    last = -1
    for i in range(n):
        before[i] = last
        if labels[i] in (GOOD, BAD):
            last = i
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] in (GOOD, BAD):
            last = i
    keep = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        near = [labels[x] for x in (a, b) if 0 <= x < n]
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
        elif label == NEAR:
            keep.append(not near or GOOD in near)
        elif len(near) < 2:
            keep.append(near == [GOOD])
        elif i - a != b - i:
            keep.append((labels[a] if i - a < b - i else labels[b]) == GOOD)
        else:
            keep.append(near == [GOOD, GOOD])
    return keep


def extract_text(html: str | None, p: dict = PARAMS) -> tuple[str, int, int]:
    """Main text, its blocks joined by line ends; number of blocks; number kept."""
    found = blocks(html) if html else []
    words = [common.WORD.findall(t.lower()) for t, _ in found]
    stop = stop_words(words, p["known"])
    keep = second_pass([first_pass(*b, w, stop, p) for b, w in zip(found, words, strict=True)])
    kept = [b[0] for b, k in zip(found, keep, strict=True) if k]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, **params: object) -> DataFrame:
    """(page_id, url, text, n_blocks, n_kept) of each row of ``pages``.

    Null, empty and tag-only pages give text '' with 0 blocks. Comments, scripts, styles and the like that aren't closed reach to
    the end of the page; other unclosed elements, tags without a '>' and stray '<' don't. At equal distance from a good and a bad
    block an undecided one goes. Time is in proportion to a page's length, whatever its markup. Repeated rows and null ids give rows of their own;
    other columns are ignored. An empty table gives no rows. Whole pages of any length are read. No shuffle.
    """
    p = PARAMS | params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            out = [extract_text(h, p) for h in b.column("html").to_pylist()]
            text, n, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(text, pa.string()), "n_blocks": pa.array(n, pa.int64()), "n_kept": pa.array(kept, pa.int64())})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id bigint, url string, text string, n_blocks bigint, n_kept bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), **PARAMS)
