"""Aggregates over time by a key, one row per asset and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import KEY, TS


def _groups(df: DataFrame, key: str, value: F.Column, at_first: bool = False) -> DataFrame:
    ts = (F.min if at_first else F.max)(TS).alias(TS)
    return df.where(F.col(key).isNotNull()).groupBy(KEY, F.col(key).alias("group_key")).agg(ts, value.alias("value"))


def groupby_numeric_agg(df: DataFrame, key: str, value: str, agg: str = "sum") -> DataFrame:
    """sum, mean, count, first, last, min or max by key; at the group's last row's time
    (first: at its first). Null keys are left out."""
    at = F.struct(TS)
    f = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "first": lambda x: F.min_by(x, at), "last": lambda x: F.max_by(x, at)}[agg]
    return _groups(df, key, f(value), agg == "first")


def groupby_boolean_agg(df: DataFrame, key: str, value: str, agg: str = "AllOf") -> DataFrame:
    f = {"AllOf": F.bool_and(value), "AnyOf": F.bool_or(value), "NoneOf": ~F.bool_or(value)}[agg]
    return _groups(df, key, f)


def groupby_any_agg(df: DataFrame, key: str, value: str, agg: str = "IsEqual", compat: bool = False) -> DataFrame:
    """IsEqual: all values equal. IsUnique: no two equal (compat: one row, or first and
    last differ)."""
    if agg == "IsEqual":
        return _groups(df, key, F.min(value) == F.max(value))
    ends = F.min_by(value, F.struct(TS)) != F.max_by(value, F.struct(TS))
    return _groups(df, key, ((F.count("*") == 1) | ends) if compat else (F.count_distinct(value) == F.count(value)))
