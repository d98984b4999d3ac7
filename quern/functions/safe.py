"""Coercions that never fail a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_text(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    """Fractions are cut off; what isn't a number becomes the default."""
    return F.coalesce(c.try_cast("int"), F.lit(default))


def clamp(c: Column, low: int = 1, high: int = 5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def family(model: Column) -> Column:
    """What stands before the first slash of a model's name, lower-cased."""
    return F.lower(F.split_part(model, F.lit("/"), F.lit(1)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def slot(values: list[str], index: Column) -> Column:
    """The value at index modulo the number of values."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def map_slice(m: Column, keys: Column) -> Column:
    """The entries of a map whose keys are listed."""
    return F.map_filter(m, lambda k, _: F.array_contains(keys, k))


def prefers(*choices: Column) -> Column:
    """The first choice that isn't null: overrides before defaults, cost fields in order, cheap results before dear ones."""
    return F.coalesce(*choices)
