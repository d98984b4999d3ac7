"""Language identification with word-first backoff.

A model is fitted on a bounded sample of rows whose language column is filled. Each word of a text (a run of letters,
lower-cased) is scored in every language: a known word by its log frequency there; an unseen word by the mean log
frequency of its known character n-grams of the greatest length that has any, from ``max_gram`` down to 1, with the word
marked ``_word_`` at both ends; a word without any known n-gram isn't scored. Scores are whole thousandths of a nat,
so that sums don't depend on the order of addition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

LETTERS = re.compile(r"[^\W\d_]+")
#: Parameters in production. sample_rows is the bound on labelled rows per language that the model is fitted on.
PARAMS = {"sample_rows": 500, "max_gram": 5, "min_count": 3, "min_margin": 40}


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, k: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + k] for i in range(len(padded) - k + 1)]


def _count(batches: Iterator[pa.RecordBatch], max_gram: int) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for batch in common.pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letter_words(text))
    for lang, known in words.items():
        for k in range(max_gram + 1):
            counts = known if k == 0 else Counter()
            if k:
                for word, n in known.items():
                    for g in grams_of(word, k):
                        counts[g] += n
            yield pa.record_batch({"lang": pa.array([lang] * len(counts), pa.string()), "k": pa.array(np.full(len(counts), k, dtype=np.int32)), "gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


class Model:
    """Scores per language, languages in alphabetical order; tables[0] has words, tables[k] n-grams of k characters.

    A table gives an n-gram's row of ``scores``. Pickled, a table is one string.
    """

    def __init__(self, langs: list[str], tables: list[dict[str, int]], scores: np.ndarray):
        self.langs, self.tables, self.scores = langs, tables, scores

    def __getstate__(self) -> tuple:
        return self.langs, [("\n".join(t), np.fromiter(t.values(), dtype=np.int32, count=len(t))) for t in self.tables], self.scores

    def __setstate__(self, state: tuple) -> None:
        self.langs, packed, self.scores = state
        self.tables = [dict(zip(names.split("\n"), rows.tolist(), strict=True)) if len(rows) else {} for names, rows in packed]

    def grams(self, word: str) -> list[int]:
        """Rows of scores whose mean is the word's: its own if it is known, else of its longest known n-grams; none if it has none."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        for k in range(len(self.tables) - 1, 0, -1):
            t = self.tables[k]
            found = [t[g] for g in grams_of(word, k) if g in t]
            if found:
                return found
        return []


def fit(docs: DataFrame, sample_rows: int = PARAMS["sample_rows"], max_gram: int = PARAMS["max_gram"], min_count: int = PARAMS["min_count"], **_: object) -> Model:
    """Fit on at most ``sample_rows`` rows of each language in column lang: those with the smallest md5 of doc_id.

    The sample is chosen by ids alone (the group limit runs before the shuffle) and its texts fetched by a join with the
    written table of those ids, which Spark broadcasts if that is under its threshold. Of rows with one doc_id and language
    the least text counts. Rows with a null lang, text or doc_id aren't used; an empty table gives a model without languages.
    """
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    usable = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    ids = common.written(usable.select("doc_id", "lang").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample_rows).select("doc_id", "lang").distinct(), "sample")
    sample = usable.join(ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    counted = sample.mapInArrow(lambda b: _count(b, max_gram), "lang string, k int, gram string, n bigint").groupBy("k", "gram", "lang").agg(F.sum("n").alias("n"))
    kept = counted.groupBy("k", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("total") >= min_count)
    got = kept.select("k", "gram", "by").toArrow()
    common.drop(ids)
    by = got.column("by").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
    where = np.repeat(np.arange(len(by)), np.diff(np.asarray(by.offsets)))
    names = by.flatten().field("lang").dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    at = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)[np.asarray(names.indices)]
    counts = np.zeros((len(by), len(langs)), dtype=np.int64)
    counts[where, at] = by.flatten().field("n").to_numpy()
    order = got.column("k").to_numpy()
    scores = np.zeros(counts.shape, dtype=np.int64)
    for k in range(max_gram + 1):
        mine = counts[order == k]
        scores[order == k] = np.floor(1000 * np.log((mine + 0.5) / (mine.sum(axis=0) + 0.5 * len(mine))))
    tables: list[dict[str, int]] = [{} for _ in range(max_gram + 1)]
    for i, (k, gram) in enumerate(zip(order.tolist(), got.column("gram").to_pylist(), strict=True)):
        tables[k][gram] = i
    return Model(langs, tables, scores.astype(np.int32))


class _Scorer:
    MEMO = 250_000

    def __init__(self, model: Model):
        self.model, self.memo, self.matrix, self.used = model, {}, np.zeros((4096, len(model.langs) + 1), dtype=np.int32), 0

    def _learn(self, words: list[str]) -> None:
        """Rows of the matrix for new words, all at once: scores and whether there are any."""
        while self.used + len(words) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        found = [self.model.grams(w) for w in words]
        counts = np.array([len(f) for f in found], dtype=np.int64)
        some = np.flatnonzero(counts)
        self.matrix[self.used : self.used + len(words)] = 0
        if len(some):
            flat = np.fromiter((g for f in found for g in f), dtype=np.int64, count=int(counts.sum()))
            sums = np.add.reduceat(self.model.scores[flat], (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
            self.matrix[self.used + some, :-1] = sums // counts[some][:, None]
            self.matrix[self.used + some, -1] = 1
        self.memo.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def sums(self, text: str) -> np.ndarray:
        """Sum of scores per language, and last the number of scored words."""
        if self.used > self.MEMO:
            self.memo, self.used = {}, 0
        words = letter_words(text)
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        return self.matrix[rows].sum(axis=0, dtype=np.int64)

    def decide(self, text: str | None, min_margin: int) -> tuple[str, int, int, bool]:
        """Language or 'und', mean margin over the second language, scored words, whether accepted."""
        if not text or not self.model.langs:
            return "und", 0, 0, False
        s = self.sums(text)
        n = int(s[-1])
        if n == 0:
            return "und", 0, 0, False
        best = int(np.argmax(s[:-1]))
        others = np.delete(s[:-1], best)
        margin = int(s[best] - others.max()) // n if len(others) else min_margin
        ok = margin >= min_margin
        return (self.model.langs[best] if ok else "und"), margin, n, ok


def identify(docs: DataFrame, model: Model, min_margin: int = PARAMS["min_margin"]) -> DataFrame:
    """(doc_id, pred_lang, margin, n_scored, accepted) for each row of ``docs``.

    Null, empty and letterless texts, and texts whose best language leads by under ``min_margin`` thousandths of a nat
    a word, get 'und' and accepted false. Ties go to the alphabetically first language, with margin 0. Repeated rows and
    null doc_ids give a row each. An empty model (no labelled rows) accepts nothing. Whole texts of any length are scored.
    Other columns are ignored, whatever their names. One narrow stage: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in common.pieces(batches):
            out = [scorer.decide(t, min_margin) for t in b.column("text").to_pylist()]
            lang, margin, n, ok = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "pred_lang": pa.array(lang, pa.string()), "margin": pa.array(margin, pa.int64()), "n_scored": pa.array(n, pa.int64()), "accepted": pa.array(ok, pa.bool_())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, pred_lang string, margin bigint, n_scored bigint, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, min_margin: int = PARAMS["min_margin"]) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns, in one narrow stage; its rules hold for every case."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in common.pieces(batches):
            yield b.filter(pa.array([scorer.decide(t, min_margin)[3] for t in b.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, **PARAMS))


def _sql() -> str:
    p, g = PARAMS, PARAMS["max_gram"]
    windows = " union all ".join(f"select lang, n, {k} as k, unnest(list_transform(range(1, length(pw) - {k} + 2), lambda i: substr(pw, i, {k}))) as gram from sw where length(pw) >= {k}" for k in range(1, g + 1))
    unseen = " union all ".join(f"select word, {k} as k, unnest(list_transform(range(1, length('_' || word || '_') - {k} + 2), lambda i: substr('_' || word || '_', i, {k}))) as gram from un where length(word) + 2 >= {k}" for k in range(1, g + 1))
    return f"""
with picked as (select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) rn
    from documents where doc_id is not null and lang is not null and text is not null) where rn <= {p["sample_rows"]}),
sample as (select lang, min(text) as text from documents where text is not null and (doc_id, lang) in (select (doc_id, lang) from picked) group by doc_id, lang),
sw as (select lang, word, '_' || word || '_' as pw, count(*) as n from (select lang, unnest(regexp_extract_all(lower(text), '\\pL+')) as word from sample) group by lang, word),
c0 as (select 0 as k, word as gram, lang, n from sw union all select k, gram, lang, sum(n)::bigint as n from ({windows}) group by k, gram, lang),
kept as (select * from c0 where (k, gram) in (select (k, gram) from c0 group by k, gram having sum(n) >= {p["min_count"]})),
totals as (select k, lang, sum(n) as t from kept group by k, lang), sizes as (select k, count(distinct gram) as v from kept group by k),
langs as (select distinct lang from kept),
scored as materialized (select g.k, g.gram, l.lang, floor(1000 * ln((coalesce(c.n, 0) + 0.5) / (coalesce(t.t, 0) + 0.5 * s.v)))::bigint as s
    from (select distinct k, gram from kept) g cross join langs l join sizes s on s.k = g.k left join totals t on t.k = g.k and t.lang = l.lang
    left join kept c on c.k = g.k and c.gram = g.gram and c.lang = l.lang),
dw as materialized (select doc_id, word, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '\\pL+')) as word from documents) group by doc_id, word),
un as (select distinct word from dw where word not in (select gram from scored where k = 0)),
ug as (select word, k, gram, count(*) as m from ({unseen}) group by word, k, gram),
hit as (select u.word, u.k, s.lang, sum(u.m * s.s) as s, sum(u.m) as m from ug u join scored s on s.k = u.k and s.gram = u.gram where s.k > 0 group by u.word, u.k, s.lang),
best as (select word, max(k) as k from hit group by word),
ws as (select gram as word, lang, s from scored where k = 0 union all select h.word, h.lang, floor(h.s / h.m)::bigint as s from hit h join best b on b.word = h.word and b.k = h.k),
ds as (select d.doc_id, w.lang, sum(d.n * w.s)::bigint as s, sum(d.n)::bigint as n from dw d join ws w on w.word = d.word group by d.doc_id, w.lang),
rk as (select doc_id, lang, s, n, row_number() over (partition by doc_id order by s desc, lang) as r from ds),
dec as (select a.doc_id, a.lang, a.n, coalesce(floor((a.s - b.s) / a.n)::bigint, {p["min_margin"]}) as margin from rk a left join rk b on b.doc_id = a.doc_id and b.r = 2 where a.r = 1)
select d.doc_id, case when coalesce(e.margin, 0) >= {p["min_margin"]} then e.lang else 'und' end as pred_lang, coalesce(e.margin, 0)::bigint as margin,
    coalesce(e.n, 0)::bigint as n_scored, coalesce(e.margin, 0) >= {p["min_margin"]} as accepted
from documents d left join dec e on e.doc_id = d.doc_id"""


SQL = _sql()
