"""Quality classification with naive Bayes support vectors.

Features are the n-grams (1 and 2 tokens) that a text holds, as indicators. Each is scaled by the class log-count ratio
r = log((p / |p|) / (q / |q|)), with p and q the smoothed numbers of good and bad training texts that hold it; rows are
scaled to length 1, so that a text's length doesn't count. A linear hinge-loss model is fitted to the scaled rows by dual
coordinate descent, and its weights are interpolated with their mean magnitude.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Words and runs of other marks, lower-cased.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Parameters in production. train_rows is the bound on labelled rows that the model is fitted on.
PARAMS = {"train_rows": 2000, "min_df": 3, "alpha": 1.0, "c": 1.0, "beta": 0.25, "epochs": 20, "threshold": 0.0}
MODEL = "gram string, weight double"
BIAS = ""


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def features(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: float, epochs: int) -> np.ndarray:
    """Weights of the hinge-loss linear model min |w|^2 / 2 + c * sum(max(0, 1 - y w x)); rows are (indices, values).

    Rows are visited in an order drawn anew each epoch from a fixed seed. Ends when no projected gradient exceeds 0.01.
    """
    w, a = np.zeros(width), np.zeros(len(rows))
    q = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if q[i] == 0:
                continue
            at, v = rows[i]
            g = y[i] * float(w[at] @ v) - 1
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == c else g
            most = max(most, abs(pg))
            if pg:
                new = min(max(a[i] - g / q[i], 0.0), c)
                w[at] += (new - a[i]) * y[i] * v
                a[i] = new
        if most < 0.01:
            break
    return w


def train(texts: list[str | None], labels: list[int], min_df: int, alpha: float, c: float, beta: float, epochs: int) -> dict[str, float]:
    """Weight of each n-gram, with its log-count ratio multiplied in, and of the bias at ''. One class only: its sign as bias alone."""
    sets = [features(tokens(t)) if t else set() for t in texts]
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return {BIAS: float(y[0])} if len(y) else {BIAS: 0.0}
    df: Counter = Counter(g for s in sets for g in s)
    vocab = {g: i for i, g in enumerate(sorted(g for g, n in df.items() if n >= min_df))}
    index = [np.array(sorted(vocab[g] for g in s if g in vocab), dtype=np.int64) for s in sets]
    p, q = np.full(len(vocab), alpha), np.full(len(vocab), alpha)
    for at, sign in zip(index, y, strict=True):
        (p if sign > 0 else q)[at] += 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    bias = len(vocab)
    rows = []
    for at in index:
        v = r[at]
        norm = float(np.sqrt(v @ v)) or 1.0
        rows.append((np.append(at, bias), np.append(v / norm, 1.0)))
    w = dual_coordinate_descent(rows, y, bias + 1, c, epochs)
    inner = (1 - beta) * np.abs(w[:-1]).mean() + beta * w[:-1] if len(vocab) else w[:-1]
    return {BIAS: float(w[-1])} | {g: (float(inner[i] * r[i]), float(r[i])) for g, i in vocab.items()}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = PARAMS["train_rows"], **params: object) -> dict:
    """Fit on at most ``train_rows`` labelled documents: those with the smallest md5 of doc_id.

    The sample is chosen by ids alone, as a top-k; its texts are fetched by a join with those ids. Documents with several
    labels count once with their smallest. Fitting runs in one task, the driver receives the weights.
    """
    p = PARAMS | params
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quern_y"))
    chosen = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quern_y")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [x for x in parts if len(x)]
        if not all_:
            return
        x = pd.concat(all_).assign(t=lambda d: d["text"].fillna("")).sort_values(["doc_id", "t"], kind="stable")
        m = train(x["t"].tolist(), x["quern_y"].tolist(), *(p[k] for k in ("min_df", "alpha", "c", "beta", "epochs")))
        yield pd.DataFrame([(g, *(w if isinstance(w, tuple) else (w, 0.0))) for g, w in m.items()], columns=["gram", "weight", "ratio"])

    # only the sample moves to the one task
    table = rows.repartition(1).mapInPandas(run, "gram string, weight double, ratio double").toArrow()
    return {g: (w, r) for g, w, r in zip(*(table.column(k).to_pylist() for k in ("gram", "weight", "ratio")), strict=True)}


class _Scorer:
    """Scores texts by word numbers: single n-grams by table, pairs by binary search of number pairs."""

    def __init__(self, model: dict):
        self.bias = model.get(BIAS, (0.0, 0.0))[0]
        grams = {g: v for g, v in model.items() if g}
        single = sorted(g for g in grams if " " not in g)
        words = sorted({w for g in grams for w in g.split(" ")})
        self.vocab = {w: i + 1 for i, w in enumerate(words)}
        self.weight, self.square = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        for g in single:
            self.weight[self.vocab[g]], self.square[self.vocab[g]] = grams[g][0], grams[g][1] ** 2
        pairs = sorted((self.vocab[a] << 32 | self.vocab[b], *grams[f"{a} {b}"]) for a, b in (g.split(" ") for g in grams if " " in g))
        self.keys = np.array([k for k, *_ in pairs] or [-1], dtype=np.int64)
        self.pair_weight, self.pair_square = np.array([w for _, w, _ in pairs] or [0.0]), np.array([r * r for *_, r in pairs] or [0.0])

    def score(self, text: str | None) -> float:
        if not text:
            return self.bias
        words = tokens(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
        both = ids[:-1] << 32 | ids[1:]
        both = np.unique(both[(ids[:-1] > 0) & (ids[1:] > 0)])
        at = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
        at = at[self.keys[at] == both]
        one = np.unique(ids)
        norm = np.sqrt(self.square[one].sum() + self.pair_square[at].sum()) or 1.0
        return self.bias + float(self.weight[one].sum() + self.pair_weight[at].sum()) / norm


def classify(docs: DataFrame, model: dict, threshold: float = PARAMS["threshold"]) -> DataFrame:
    """(doc_id, score, good) of each row of ``docs``: good is score >= threshold, so that ties are good.

    Null and empty texts, and those without a known n-gram, get the bias. Whole texts of any length count. Repeated rows and
    null doc_ids give rows of their own; other columns are ignored. An empty table gives no rows; a model without labelled
    rows scores 0. One narrow stage: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in common.pieces(batches):
            scores = [round(scorer.score(t), 6) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64()), "good": pa.array([s >= threshold for s in scores], pa.bool_())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, good boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, common.table(spark, sf_dir, "labels"), **PARAMS), PARAMS["threshold"])
