"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic); the cells' weights are raked until the sums over each source,
language and topic meet their targets; documents are then drawn, without replacement, by probabilities calibrated to the
raked weights. How many tokens can be drawn so depends on the scarcest cells: the budget is the largest whole percentage of the tokens at
which the shares expected of every source, language and topic are within ``tolerance`` of their targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Topics by the first marker that a text holds; all other texts are TOPIC_REST.
TOPICS = (("legal", ("icense", "ICENSE")), ("contact", ("@",)), ("markup", ("###", "%%%", " | ")))
TOPIC_REST = "prose"
#: Parameters in production: targets are shares of tokens to these powers, made to sum to 1; keep is the greatest share of all tokens to draw.
PARAMS = {"source_power": 0.7, "lang_power": 0.7, "topic_power": 0.9, "keep": 0.9, "tolerance": 0.01, "seed": "mix"}
MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Rounds of raking in the SQL, which can't test for convergence: more than the tables need.
SQL_ROUNDS = 300


def n_tokens(text: str = "text") -> Column:
    """Tokens of a text: runs without white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("\\S+")), F.lit(0)).cast("bigint")


def topic_of(text: str = "text") -> Column:
    c = None
    for name, marks in TOPICS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(F.col(text), F.lit(m))
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return c.otherwise(TOPIC_REST)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], near: float = 1e-12) -> np.ndarray:
    """Weights of cells, from their token counts, scaled in turn to each margin's targets until all are met to within ``near``.

    Where empty cells make that impossible, it ends once a hundred rounds have brought no margin nearer.
    """
    w, best, since = tokens.astype(float), np.inf, 0
    while since < 100:
        for code, target in zip(codes, targets, strict=True):
            w = w * (target / np.bincount(code, weights=w, minlength=len(target)))[code]
        off = max(np.abs(np.bincount(c, weights=w, minlength=len(t)) - t).max() for c, t in zip(codes, targets, strict=True))
        if off <= near:
            break
        best, since = (off, 0) if off < best * (1 - 1e-6) else (best, since + 1)
    return w


def calibrate(tokens: np.ndarray, factor: np.ndarray, budget: float) -> np.ndarray:
    """Scale t so that the sum of min(1, t * factor) * tokens is ``budget``; the probabilities min(1, t * factor)."""
    order = np.argsort(-factor, kind="stable")
    f, n = factor[order], tokens[order].astype(float)
    whole = np.concatenate([[0.0], np.cumsum(n)[:-1]])
    rest = np.cumsum((f * n)[::-1])[::-1]
    t = (budget - whole) / rest
    ok = np.flatnonzero(t * f <= 1 + 1e-12)
    return np.minimum(1.0, (t[ok[0]] if len(ok) else np.inf) * factor)


def feasible(tokens: np.ndarray, factor: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, tolerance: float) -> np.ndarray:
    """Probabilities at the largest budget, in whole percentages of the tokens up to ``keep``, at which each margin's expected shares are
    within ``tolerance`` of their targets; where there is none, at the largest budget that clips no cell, or 1% if less."""
    total = int(tokens.sum())
    for k in range(int(round(100 * keep)), 0, -1):
        prob = calibrate(tokens, factor, k / 100 * total)
        drawn = prob * tokens
        if all(np.abs(np.bincount(c, weights=drawn, minlength=len(t)) / drawn.sum() - t).max() <= tolerance for c, t in zip(codes, targets, strict=True)):
            return prob
    return calibrate(tokens, factor, min(0.01, 1 / factor.max()) * total)


def _plan(cells: pd.DataFrame, p: dict) -> pd.DataFrame:
    cells = cells.sort_values(list(MARGINS)).reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(dtype=np.int64)
    total = int(tokens.sum())
    codes, targets = [], []
    for m in MARGINS:
        code, _ = pd.factorize(cells[m], sort=True)
        share = np.bincount(code, weights=tokens) / total
        goal = share ** p[f"{m}_power"]
        codes.append(code)
        targets.append(goal / goal.sum())
    raked = rake(tokens, codes, targets)
    factor = raked * total / tokens
    prob = feasible(tokens, factor, codes, targets, p["keep"], p["tolerance"])
    return cells[list(MARGINS)].assign(target=raked / raked.sum(), prob=prob, expected=prob * tokens / (prob * tokens).sum())


def cell_plan(docs: DataFrame, **params: object) -> DataFrame:
    """(source, lang, topic, target, prob, expected) of each cell that has tokens.

    Counts cover all documents. The fit runs in one task over the cells, whose number depends on the distinct sources,
    languages and topics, not on the documents; the result is a written table.
    """
    p = PARAMS | params
    key = [F.coalesce(F.col("source"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang"), F.lit(NONE)).alias("lang"), topic_of().alias("topic")]
    cells = docs.select(*key, n_tokens().alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [x for x in parts if len(x)]
        if all_:
            yield _plan(pd.concat(all_), p)

    return common.written(cells.coalesce(1).mapInPandas(run, "source string, lang string, topic string, target double, prob double, expected double"), "cells")


def _drawn(docs: DataFrame, p: dict) -> DataFrame:
    """The rows drawn, as struct quern_row, with source, lang, topic, target, prob and expected.

    The left join keeps text in place while the table of cells is under Spark's broadcast threshold.
    """
    row = "quern_row."
    key = F.coalesce(F.col(row + "doc_id").cast("string"), F.col(row + "text"), F.lit(""))
    have = docs.select(common.packed(docs))
    have = have.select("quern_row", F.coalesce(row + "source", F.lit(NONE)).alias("source"), F.coalesce(row + "lang", F.lit(NONE)).alias("lang"), topic_of(row + "text").alias("topic"), common.md5_unit(key, p["seed"]).alias("u"))
    return have.join(cell_plan(docs, **p), list(MARGINS), "left").where(F.coalesce(F.col("u") < F.col("prob"), F.lit(False)))


def mix(docs: DataFrame, **params: object) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept.

    A null source or language is a value of its own, '(none)'. Texts that are null or have no token are in no drawn cell
    unless others of the cell have tokens; they then share its probability. A row's number in [0, 1) comes from its doc_id (its text
    where that is null), so repeated rows stay or go together. An empty table gives no rows.

    Very long texts count whole, and ties don't arise: a row is drawn if its number is under its cell's probability. Columns of
    the input may have any names.
    """
    return _drawn(docs, PARAMS | params).select("quern_row.*")


def mix_plan(docs: DataFrame, **params: object) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, prob, target, expected) of the rows drawn: target is the raked share of the row's cell
    in the tokens, expected the share that it is expected to have in those drawn. All else is as in ``mix``."""
    d = _drawn(docs.select("doc_id", "source", "lang", "text"), PARAMS | params)
    return d.select(F.col("quern_row.doc_id").cast("bigint").alias("doc_id"), *MARGINS, n_tokens("quern_row.text").alias("n_tokens"), F.round("prob", 6).alias("prob"), F.round("target", 6).alias("target"), F.round("expected", 6).alias("expected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.table(spark, sf_dir, "documents"), **PARAMS)


def _sql() -> str:
    p = PARAMS
    topic = "case " + " ".join(f"when {' or '.join(f"contains(text, '{m}')" for m in marks)} then '{name}'" for name, marks in TOPICS) + f" else '{TOPIC_REST}' end"
    goals = ", ".join(f"g_{m} as (select {m}, x / sum(x) over () as t_{m} from (select {m}, power(sum(tokens)::double / (select sum(tokens) from cells), {p[f'{m}_power']}) as x from cells group by {m}))" for m in MARGINS)
    return f"""
with recursive d as materialized (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, {topic} as topic, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::bigint as n_tokens,
    ('0x' || substr(md5('{p["seed"]}' || coalesce(doc_id::varchar, text, '')), 1, 13))::bigint / power(16, 13) as u from documents),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all having sum(n_tokens) > 0),
{goals},
w0 as materialized (select source, lang, topic, tokens, tokens::double as w, t_source, t_lang, t_topic from cells join g_source using (source) join g_lang using (lang) join g_topic using (topic)),
raked as (select 0 as r, * from w0 union all
    select r + 1, source, lang, topic, tokens, w * t_topic / sum(w) over (partition by topic), t_source, t_lang, t_topic from
    (select * replace (w * t_lang / sum(w) over (partition by lang) as w) from
    (select * replace (w * t_source / sum(w) over (partition by source) as w) from raked where r < {SQL_ROUNDS}))),
f as materialized (select *, w * (select sum(tokens) from cells) / tokens as f, w / sum(w) over () as target from raked where r = {SQL_ROUNDS}),
o as (select *, coalesce(sum(tokens) over (order by f desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as whole,
    sum(f * tokens) over (order by f desc, source, lang, topic rows between current row and unbounded following) as rest from f),
budgets as (select unnest(range(1, {round(100 * p["keep"])} + 1)) as k, unnest(range(1, {round(100 * p["keep"])} + 1)) / 100.0::double as keep
    union all select 0, least(0.01, 1 / (select max(f) from f))),
s as (select k, coalesce(first(t order by f desc, source, lang, topic) filter (where t * f <= 1 + 1e-12), 1e300) as t
    from (select k, (keep * (select sum(tokens) from cells) - whole) / rest as t, f, source, lang, topic from o, budgets) group by k),
probs as materialized (select k, source, lang, topic, tokens, target, t_source, t_lang, t_topic, least(1.0, t * f) as prob from f, s),
shares as materialized (select *, prob * tokens / sum(prob * tokens) over (partition by k) as expected from probs),
off as ({" union all ".join(f"select k, max(abs(e - t)) as off from (select k, {m}, sum(expected) as e, any_value(t_{m}) as t from shares group by k, {m}) group by k" for m in MARGINS)}),
chosen as (select coalesce(max(k), 0) as k from (select k from off where k > 0 group by k having max(off) <= {p["tolerance"]})),
plan as (select source, lang, topic, target, prob, expected from shares where k = (select k from chosen))
select d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.prob, 6) as prob, round(p.target, 6) as target, round(p.expected, 6) as expected
from d join plan p on p.source = d.source and p.lang = d.lang and p.topic = d.topic where d.u < p.prob"""


SQL = _sql()
