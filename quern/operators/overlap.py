"""Contamination: shared n-grams, cosine similarity and provenance of dates between held-out and reference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text


def ngram_overlap(held: DataFrame, ref: DataFrame, n: int = 8, held_id: str = "held_id", ref_id: str = "ref_id", body: str = "text") -> DataFrame:
    """(held_id, ref_id, shared): pairs that share at least one distinct word n-gram, and how many.

    An inverted index: n-grams are exploded and joined on their 64-bit hash and themselves, so that pairs without a common n-gram never
    meet. Spark broadcasts a side only below its size threshold.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        # words as a column of their own: inside the lambda the expression would run once an n-gram
        w = df.select(F.col(key), text.words(F.lower(F.col(body))).alias("quern_w"))
        return w.select(F.col(key), F.explode(text.ngram_set(F.col("quern_w"), n)).alias("gram"))

    return grams(held, held_id).join(grams(ref, ref_id), "gram").groupBy(held_id, ref_id).agg(F.count("*").alias("shared"))


def term_vectors(df: DataFrame, key: str, body: str = "text") -> DataFrame:
    """(key, token, tf, norm): counts of each token of a text and the length of the whole vector."""
    tf = df.select(key, F.explode(text.tokens(F.col(body))).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("tf"))
    return tf.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key))))


def hash_vectors(df: DataFrame, key: str, body: str = "text", dim: int = 256, independent_sign: bool = False) -> DataFrame:
    """(key, token, tf, norm) with feature-hashed tokens: place is the hash modulo dim, sign its second bit.

    With a dim that is a power of 2 the sign then follows from the place; independent_sign takes a bit above the place.
    """
    h = text.sha_number(F.col("tok"))
    sign = F.when((F.shiftright(h, 31) if independent_sign else F.shiftright(h, 1)).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    raw = df.select(key, F.explode(text.tokens(F.col(body))).alias("tok"))
    v = raw.groupBy(key, (h % dim).alias("token")).agg(F.sum(sign).alias("tf")).where("tf <> 0")
    return v.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key))))


def sparse_cosine(held: DataFrame, ref: DataFrame, held_id: str = "held_id", ref_id: str = "ref_id") -> DataFrame:
    """(held_id, ref_id, cosine) of pairs of vectors with a common token; all others have cosine 0."""
    a = held.select(held_id, "token", F.col("tf").alias("ta"), F.col("norm").alias("na"))
    b = ref.select(ref_id, "token", F.col("tf").alias("tb"), F.col("norm").alias("nb"))
    return a.join(b, "token").groupBy(held_id, ref_id).agg((F.sum(F.col("ta") * F.col("tb")) / (F.first("na") * F.first("nb"))).alias("cosine"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 when one has no length."""
    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(da, da)) * F.sqrt(dot(db, db))
    return F.when(n == 0, 0.0).otherwise(dot(da, db) / n)


def dense_pairs(held: DataFrame, ref: DataFrame, threshold: float, held_id: str, ref_id: str, vec: str = "embedding", block: int = 2048) -> DataFrame:
    """(held_id, ref_id, cosine) of all pairs of dense vectors at or over the threshold, by matrix products of blocks.

    Both sides are packed into blocks of rows; each pair of blocks is one product in numpy. Every pair is compared.
    """
    import numpy as np
    import pandas as pd

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        def pack(parts):
            for p in parts:
                for i in range(0, len(p), block):
                    x = p.iloc[i : i + block]
                    m = np.stack([np.asarray(v, dtype=np.float64) for v in x[vec]])
                    yield pd.DataFrame({f"{name}_ids": [x[key].to_numpy(dtype=np.int64).tobytes()], f"{name}_m": [m.tobytes()], f"{name}_d": [m.shape[1]]})

        return df.where(F.col(vec).isNotNull()).select(key, vec).mapInPandas(pack, f"{name}_ids binary, {name}_m binary, {name}_d int")

    def multiply(parts):
        for p in parts:
            for r in p.itertuples(index=False):
                if r.a_d != r.b_d:
                    continue
                a, b = (np.frombuffer(m, dtype=np.float64).reshape(-1, d) for m, d in ((r.a_m, r.a_d), (r.b_m, r.b_d)))
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                c = a @ b.T / np.where(na == 0, np.inf, na)[:, None] / np.where(nb == 0, np.inf, nb)[None, :]
                i, j = np.nonzero(c >= threshold)
                yield pd.DataFrame({held_id: np.frombuffer(r.a_ids, dtype=np.int64)[i], ref_id: np.frombuffer(r.b_ids, dtype=np.int64)[j], "cosine": c[i, j]})

    return packed(held, held_id, "a").crossJoin(packed(ref, ref_id, "b")).mapInPandas(multiply, f"{held_id} bigint, {ref_id} bigint, cosine double")


def fingerprint(flat: DataFrame, extended: bool = False) -> Column:
    """Comparison text of flat tasks: 11 fields, or 13 with company size and capacity state."""
    names = ["domain", "segment", "segment_conf", "roles_today", "roles_60", "closed_at", "layoff_date", "started_at", "stack", "headcount", "outreach_type"]
    if extended:
        names += ["company_size", "bench_state"]
    return text.normalize(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)))


def provenance_issues(df: DataFrame, keys: list[str], generated: str, events: dict[str, str], window_days: int = 730) -> DataFrame:
    """(keys, field, issue, lookback_days) for dates that can't be right; a row may have several.

    generated is an ISO timestamp as text (no zone: UTC); events maps field names to columns of dates as text. A row whose
    generated time can't be read has that one issue. An impossible date is an invalid format.
    """
    at = F.try_to_timestamp(F.regexp_replace(F.col(generated), "Z$", "+00:00"))
    rows = df.select(*keys, F.col(generated).alias("g_raw"), at.alias("g"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw")) for f, c in events.items()))).alias("e"))
    raw, good = F.col("e.raw"), F.regexp_like("e.raw", F.lit(r"^[0-9]{4}(-[0-9]{2}){2}$"))
    day = F.when(good, F.try_to_timestamp(F.concat(raw, F.lit("T00:00:00+00:00"))))
    lag = F.floor((F.unix_micros("g") - F.unix_micros(day)) / F.lit(86_400_000_000)).cast("bigint")
    none = F.lit(None).cast("bigint")
    issue = lambda name, days=none: F.struct(F.lit(name).alias("issue"), days.alias("lookback_days"))
    dated = rows.where("g is not null").select(*keys, "e.field", F.explode(F.array_compact(F.array(
        F.when(F.contains(raw, F.lit("YYYY")), issue("placeholder_date")).when(day.isNull(), issue("invalid_date_format")),
        F.when(~F.contains(raw, F.lit("YYYY")) & (day > F.col("g")), issue("event_after_generation")),
        F.when(~F.contains(raw, F.lit("YYYY")) & (lag > window_days), issue("outside_signal_window", lag)),
    ))).alias("i"))
    unread = rows.where("g is null").select(*keys).distinct().select(*keys, F.lit(generated).alias("field"), issue("invalid_iso_datetime").alias("i"))
    return dated.unionByName(unread).select(*keys, "field", "i.issue", "i.lookback_days")


def best_pair(pairs: DataFrame, value: str, held_id: str, ref_id: str) -> DataFrame:
    """The pair of the greatest value; of equals the one with the smallest ids."""
    return pairs.orderBy(F.desc(value), held_id, ref_id).limit(1)


def report(tasks: DataFrame, split: str, key: str, body: str, vectors, n: int = 8, threshold: float = 0.85) -> DataFrame:
    """One row per reference split: (ref_split, max_shared, ngram_pairs, max_cosine, cosine_pairs, pass), held_out against it.

    vectors: ``term_vectors`` or ``hash_vectors``.
    """
    named = tasks.select(F.col(key).alias("id"), F.col(split).alias("split"), F.col(body).alias("text"))
    held = named.where("split = 'held_out'").select(F.col("id").alias("held_id"), "text")
    ref = named.where("split <> 'held_out'").select(F.col("id").alias("ref_id"), "text")
    of = named.select(F.col("id").alias("ref_id"), F.col("split").alias("ref_split"))
    grams = ngram_overlap(held, ref, n).join(of, "ref_id").groupBy("ref_split").agg(F.max("shared").alias("max_shared"), F.count("*").alias("ngram_pairs"))
    cos = sparse_cosine(vectors(held, "held_id"), vectors(ref, "ref_id")).join(of, "ref_id").groupBy("ref_split").agg(F.max("cosine").alias("max_cosine"), F.count_if(F.col("cosine") >= threshold).alias("cosine_pairs"))
    splits = of.select("ref_split").where("ref_split <> 'held_out'").distinct()
    out = splits.join(grams, "ref_split", "left").join(cos, "ref_split", "left").na.fill(0)
    return out.select("ref_split", "max_shared", "ngram_pairs", F.round("max_cosine", 6).alias("max_cosine"), "cosine_pairs", ((F.col("max_shared") < 1) & (F.col("max_cosine") < threshold)).alias("pass"))


def summary(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of all of ``report``'s rows: greatest values, numbers of pairs, number of provenance flags; passed if every split passes
    and there is no flag."""
    flags = issues.agg(F.count("*").alias("flags"))
    whole = reports.agg(F.max("max_shared").alias("max_shared"), F.sum("ngram_pairs").alias("ngram_pairs"), F.max("max_cosine").alias("max_cosine"), F.sum("cosine_pairs").alias("cosine_pairs"), F.bool_and("pass").alias("splits_pass"))
    both = whole.unionByName(flags, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("max_shared", "ngram_pairs", "max_cosine", "cosine_pairs", "flags", "splits_pass")))
    return both.select("max_shared", "ngram_pairs", "max_cosine", "cosine_pairs", "flags", (F.coalesce("splits_pass", F.lit(True)) & (F.col("flags") == 0)).alias("passed"))
