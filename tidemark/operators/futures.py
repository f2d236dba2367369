"""Continuous futures: a root's contracts rolled into one series and adjusted.

Contracts are rows of asset_id (the root), ts, contract, expiry and o, h, l, c, v, oi. Which
contract is in front is decided once a day, on the day's first time of the root, and only
there does a roll rule need a loop, over a root's days; bars are then joined to the front and
the next contract, and adjustments are running sums or products over the rolls.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import KEY, TS

PRICES = ("o", "h", "l", "c")
_ROLLS = "asset_id string, ts timestamp, front string, back string"


def _at_or_after(times: DataFrame, bars: DataFrame) -> DataFrame:
    """times(asset_id, contract, ts) with bars' struct bar: the contract's first one at or
    after the time (null if it has none)."""
    both = times.withColumn("bar", F.lit(None).cast(dict(bars.dtypes)["bar"])).withColumn("asked", F.lit(True)).unionByName(bars.select(KEY, "contract", TS, "bar").withColumn("asked", F.lit(False)))
    on = Window.partitionBy(KEY, "contract").orderBy(F.col(TS).desc(), F.col("asked")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bar", F.last("bar", ignorenulls=True).over(on)).where("asked").drop("asked")


def _rolled(rule: str, offset: int):
    """A root's rows of (day, decided, contract, expiry, month_start, first, last, oi), a contract's
    first bar of each of its days -> the front and next contract from each decision on."""

    def run(rows):
        import pandas as pd

        spans = rows.drop_duplicates("contract").sort_values(["expiry", "contract"])
        names, firsts, lasts, expiries, months = (spans[x].tolist() for x in ("contract", "first", "last", "expiry", "month_start"))
        rows = rows.sort_values("day", kind="stable")
        held = {name: (g["day"].tolist(), g["oi"].tolist()) for name, g in rows.groupby("contract")}

        def interest(i: int, day: int) -> float:
            """Of the contract's first bar on the day or later; not a number if it has none."""
            days, oi = held[names[i]]
            k = bisect_left(days, day)
            return oi[k] if k < len(days) and oi[k] is not None else float("nan")

        def due(front: int, back: int, day: int) -> bool:
            if rule == "last_trading_day":
                return expiries[front] <= day + offset
            if rule == "first_of_month":
                return months[front] + offset == day
            least = interest(front, day)
            return least > 0 and interest(back, day) / least >= 1 + offset / 100

        at, end, out = 0, len(names) - 1, []
        decisions = rows.drop_duplicates("day")
        for day, ts in zip(decisions["day"].tolist(), decisions["decided"].tolist(), strict=True):
            while at < end and ts > lasts[at]:
                at += 1
            if ts < firsts[at]:
                continue
            if at < end and due(at, at + 1 if ts >= firsts[at + 1] else at, day):
                at += 1
            out.append((rows[KEY].iloc[0], ts, names[at], names[min(at + 1, end)]))
        return pd.DataFrame(out, columns=[KEY, TS, "front", "back"])

    return run


def legs(contracts: DataFrame, rule: str = "liquidity", offset: int = 0) -> DataFrame:
    """contracts -> asset_id, ts, front, back, front_bar, back_bar: the contract in front at
    each time of the root and the next one, with their bars at or after it. The back leg is
    the front's where the next contract does not trade yet; times without a front are left
    out. rule: liquidity (the next contract's open interest is 1 + offset/100 times the
    front's), last_trading_day (offset days before the expiry) or first_of_month (offset
    days after the first of the expiry's month); a contract past its last bar is rolled
    whatever the rule says. Days are calendar days."""
    if rule not in ("liquidity", "last_trading_day", "first_of_month"):
        raise ValueError(f"no roll rule {rule}")
    bars = contracts.select(KEY, "contract", TS, F.struct(*PRICES, "v", "oi").alias("bar"))
    spans = contracts.groupBy(KEY, "contract").agg(F.max("expiry").cast("date").alias("expiry"), F.min(TS).alias("first"), F.max(TS).alias("last"))
    times = contracts.select(KEY, TS).distinct()
    # On a day's first time, a contract's bar at or after it is its first one of that day or a later one.
    daily = contracts.groupBy(KEY, "contract", F.to_date(TS).alias("d")).agg(F.min(TS).alias(TS), F.min_by("oi", TS).alias("oi"))
    daily = daily.withColumn("decided", F.min(TS).over(Window.partitionBy(KEY, "d"))).join(spans, [KEY, "contract"])
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    rows = daily.select(KEY, number("d").alias("day"), "decided", "contract", number("expiry").alias("expiry"), number(F.trunc("expiry", "month")).alias("month_start"), "first", "last", "oi")
    rolls = rows.groupBy(KEY).applyInPandas(_rolled(rule, offset), _ROLLS)
    day = Window.partitionBy(KEY, F.to_date(TS))
    held = times.withColumn("decided", F.min(TS).over(day)).join(rolls.withColumnRenamed(TS, "decided"), [KEY, "decided"]).drop("decided")
    held = held.join(spans.select(KEY, F.col("contract").alias("back"), F.col("first").alias("starts")), [KEY, "back"])
    held = held.withColumn("leg", F.when(F.col(TS) >= F.col("starts"), F.col("back")).otherwise(F.col("front")))
    front = _at_or_after(held.select(KEY, F.col("front").alias("contract"), TS), bars).select(KEY, TS, F.col("bar").alias("front_bar"))
    back = _at_or_after(held.select(KEY, F.col("leg").alias("contract"), TS), bars).select(KEY, TS, F.col("bar").alias("back_bar"))
    return held.select(KEY, TS, "front", "back").join(front, [KEY, TS]).join(back, [KEY, TS]).where("front_bar is not null and back_bar is not null")


def continuous(contracts: DataFrame, rule: str = "liquidity", offset: int = 0, direction: str = "backward", style: str = "difference") -> DataFrame:
    """asset_id, ts, contract, o, h, l, c, v, oi: the front bars, prices adjusted. At a roll's
    first row the back leg less the front one (style ratio: over it) is the roll's step;
    backward puts the steps of all later rolls on a row, forward those up to it. Volume
    and open interest stay."""
    if direction not in ("backward", "forward") or style not in ("difference", "ratio"):
        raise ValueError(f"no adjustment {direction} {style}")
    w = Window.partitionBy(KEY).orderBy(TS)
    out = legs(contracts, rule, offset).withColumn("rolled", F.coalesce(F.col("front") != F.lag("front").over(w), F.lit(False)))
    ahead = w.rowsBetween(1, Window.unboundedFollowing) if direction == "backward" else w.rowsBetween(Window.unboundedPreceding, 0)

    def adjusted(x: str) -> Column:
        front, back = F.col(f"front_bar.{x}"), F.col(f"back_bar.{x}")
        if style == "difference":
            return (front + F.coalesce(F.sum(F.when(F.col("rolled"), back - front)).over(ahead), F.lit(0.0))).alias(x)
        return (front * F.coalesce(F.product(F.when(F.col("rolled"), back / front)).over(ahead), F.lit(1.0))).alias(x)

    return out.select(KEY, TS, F.col("front").alias("contract"), *map(adjusted, PRICES), F.col("front_bar.v").alias("v"), F.col("front_bar.oi").alias("oi"))
