"""Boundary to generators, judges and embedders: a client called in Arrow batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import whole_json
from quern.operators.selection import call_cost

Client = Callable[[list[str]], list[str]]


def call(df: DataFrame, key: str, prompt: str, client: Client, batch: int = 10, attempts: int = 3, wait: float = 1.5) -> DataFrame:
    """(key, output, attempt, success, error): the client's answers, in batches, with a linear wait between attempts.

    A batch that fails every time gives rows with null output. Spark may run a task twice; a client that
    bills by call should be idempotent by key.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), batch):
                x = p.iloc[i : i + batch]
                out, error, k = [None] * len(x), None, 0
                for k in range(1, attempts + 1):
                    try:
                        out, error = client(x[prompt].tolist()), None
                        break
                    except Exception as e:  # the client is the caller's: any failure is a failed attempt
                        error = str(e)
                        if k < attempts:
                            time.sleep(wait * k)
                yield pd.DataFrame({key: x[key].to_numpy(), "output": out, "attempt": k, "success": error is None, "error": error})

    return df.select(key, prompt).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, output string, attempt int, success boolean, error string")


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding) by a given encoder. Without one use quern.operators.overlap.hash_vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key].to_numpy(), "embedding": [list(map(float, v)) for v in encode(p[text].fillna("").tolist())]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def usage(raw: Column) -> Column:
    """Struct (prompt_tokens, completion_tokens, cost) of a chat answer's JSON: tokens it doesn't give count 0, an unknown cost is null."""
    v = whole_json(raw)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    tokens = lambda k: F.coalesce(get(f"$.usage.{k}", "bigint"), F.lit(0).cast("bigint")).alias(k)
    cost = call_cost(get("$.usage.cost", "double"), get("$.usage.total_cost", "double"), get("$.cost", "double"))
    return F.struct(tokens("prompt_tokens"), tokens("completion_tokens"), cost.alias("cost"))


def embed_or_hash(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[DataFrame, str]:
    """Vectors by the encoder, or by feature hashing where there is none, and which of the two it was: "model" or "hash"."""
    from quern.operators.overlap import hash_vectors

    return (embed(df, key, text, encode), "model") if encode else (hash_vectors(df, key, text), "hash")
