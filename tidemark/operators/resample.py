"""Resampling bars to a coarser timeframe: right-closed, labelled by the right end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import KEY, TS

WEEK_END = {"SUN": 6, "MON": 0, "FRI": 4}
_FIRST, _SUM, _MEAN = {"o"}, {"v", "n"}, {"vw"}


def label(timeframe: str, ts: str = TS) -> Column:
    """The label of the bar of a timeframe that a time falls into: 5Min, 2H, 1D, 1W-FRI,
    1MS, 1ME, 1QS, 1QE, 1YS, 1YE."""
    t = F.col(ts).cast("timestamp")
    n = int("".join(c for c in timeframe.split("-")[0] if c.isdigit()) or 1)
    unit = timeframe.lstrip("0123456789")
    if unit in ("Min", "H"):
        step = n * (60_000_000 if unit == "Min" else 3_600_000_000)
        return F.timestamp_micros(F.ceil(F.unix_micros(t) / F.lit(step)) * F.lit(step))
    day = F.to_date(t)
    if unit == "D":
        return F.timestamp_micros(F.unix_micros(F.date_trunc("day", t)) if n == 1 else F.ceil(F.unix_micros(F.date_trunc("day", t)) / F.lit(n * 86_400_000_000)) * F.lit(n * 86_400_000_000))
    if unit.startswith("W-"):
        end = WEEK_END[unit[2:5]]
        return F.date_add(day, F.pmod(F.lit(end) - F.weekday(day), F.lit(7))).cast("timestamp")
    of = {"M": "month", "Q": "quarter", "Y": "year"}[unit[0]]
    start = F.trunc(day, of)
    if unit[1] == "S":  # a start label closes what came after the start before
        return F.when(day == start, start).otherwise(F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[of])).cast("timestamp")
    return F.date_add(F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[of]), -1).cast("timestamp")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """o first, h max, l min, c last, v and n sums, vw mean, any other column its last
    non-null value."""
    out = []
    for c in bars.columns:
        if c in (KEY, TS):
            continue
        x = F.col(c)
        at = F.when(x.isNotNull(), F.col(TS))
        out.append(
            (F.min_by(x, TS) if c in _FIRST else F.max(x) if c == "h" else F.min(x) if c == "l" else F.sum(x) if c in _SUM else F.avg(x) if c in _MEAN else F.max_by(x, at)).alias(c)
        )
    return bars.groupBy(KEY, label(timeframe).alias("__label")).agg(*out).withColumnRenamed("__label", TS).select(*bars.columns)


def bars_of(df: DataFrame, asset: str, ts: str, price: str, tie: str, unit: str = "day") -> DataFrame:
    """Bars of a table of priced rows: by asset and time unit, first and last by (ts, tie)."""
    order = F.struct(ts, tie)
    return df.groupBy(F.col(asset).cast("string").alias(KEY), F.date_trunc(unit, F.col(ts).cast("timestamp")).alias(TS)).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.count("*").cast("double").alias("v")
    )
