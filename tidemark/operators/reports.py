"""Reports: small result tables by asset, and event markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import KEY, TS


def aggregate(agg: str, x: str) -> Column:
    """One of the report aggregates of a column."""
    return {
        "approximate_median": lambda: F.percentile_approx(x, 0.5), "count_all": lambda: F.count("*"), "count": lambda: F.count(x), "count_distinct": lambda: F.count_distinct(x),
        "first": lambda: F.min_by(x, TS), "last": lambda: F.max_by(x, TS), "kurtosis": lambda: F.kurtosis(x), "skew": lambda: F.skewness(x),
        "max": lambda: F.max(x), "min": lambda: F.min(x), "mean": lambda: F.avg(x), "product": lambda: F.product(x), "sum": lambda: F.sum(x),
        "stddev": lambda: F.stddev_samp(x), "variance": lambda: F.var_samp(x), "tdigest": lambda: F.percentile_approx(x, 0.5, 10000),
        "all": lambda: F.bool_and(x), "any": lambda: F.bool_or(x),
    }[agg]()


def cards(df: DataFrame, x: str, agg: str, title: str = "", category: str = "") -> DataFrame:
    """numeric, boolean and any cards, one for each asset (also the cross-asset cards)."""
    return df.groupBy(KEY).agg(aggregate(agg, x).alias("value")).select(KEY, F.lit(category).alias("category"), F.lit(title).alias("title"), "value")


def index_card(df: DataFrame, x: str, target: object) -> DataFrame:
    """The position of the first row with the value, -1 if none."""
    at = df.withColumn("__i", F.row_number().over(Window.partitionBy(KEY).orderBy(TS)) - 1)
    return at.groupBy(KEY).agg(F.coalesce(F.min(F.when(F.col(x) == F.lit(target), F.col("__i"))), F.lit(-1)).alias("value"))


def quantile_card(df: DataFrame, x: str, quantile: float, interpolation: str = "linear") -> DataFrame:
    q = min(max(quantile, 0.0), 1.0)
    if interpolation == "linear":
        return df.groupBy(KEY).agg(F.percentile(x, q).alias("value"))
    values = F.array_sort(F.collect_list(x))
    at = df.groupBy(KEY).agg(values.alias("a")).withColumn("p", (F.size("a") - 1) * F.lit(q))
    lower, upper = F.get("a", F.floor("p").cast("int")), F.get("a", F.ceil("p").cast("int"))
    value = {"lower": lower, "higher": upper, "midpoint": (lower + upper) / 2, "nearest": F.get("a", F.bround("p").cast("int"))}[interpolation]
    return at.select(KEY, value.alias("value"))


def table_report(df: DataFrame, select_key: str, columns: dict[str, str]) -> DataFrame:
    """The rows where select_key holds, columns by their titles."""
    return df.where(select_key).select(KEY, TS, *[F.col(c).alias(title) for c, title in columns.items()])


def event_marker(df: DataFrame, select_key: str, columns: list[str]) -> DataFrame:
    """The rows where select_key holds, with their time as pivot."""
    return df.where(select_key).select(KEY, F.col(TS).alias("pivot"), *columns)


def bar_chart(df: DataFrame, label: str, value: str, agg: str = "sum") -> DataFrame:
    """One bar for each label of an asset, numbered as first seen."""
    out = df.where(F.col(label).isNotNull()).groupBy(KEY, F.col(label).alias("label")).agg(aggregate(agg, value).alias("value"), F.min(F.struct(TS, label)).alias("__seen"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(KEY).orderBy("__seen", "label"))).drop("__seen")


def pie_chart(df: DataFrame, label: str, value: str) -> DataFrame:
    """Each label's share of the asset's total in percent; null labels count in the total."""
    total = df.groupBy(KEY, F.col(label).alias("label")).agg(F.sum(value).alias("s"))
    share = 100 * F.col("s") / F.sum("s").over(Window.partitionBy(KEY))
    return total.withColumn("percent", share).where(F.col("label").isNotNull()).drop("s")


def nested_pie_chart(df: DataFrame, inner: str, outer: str, value: str) -> DataFrame:
    rings = [pie_chart(df, x, value).withColumn("ring", F.lit(ring)) for x, ring in ((inner, "inner"), (outer, "outer"))]
    return rings[0].unionByName(rings[1])


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins from the asset's minimum to its maximum, the last bin closed."""
    ends = df.where(F.col(value).isNotNull()).groupBy(KEY).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counted = df.where(F.col(value).isNotNull()).join(ends, KEY).groupBy(KEY, "lo", "hi", x.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(KEY, "bin", (F.col("lo") + F.col("bin") * width).alias("start"), (F.col("lo") + (F.col("bin") + 1) * width).alias("stop"), "count")


def cs_table(df: DataFrame, x: str, agg: str = "last") -> DataFrame:
    """One text cell for each asset, N/A without a value."""
    return df.groupBy(KEY).agg(F.coalesce(aggregate(agg, x).cast("string"), F.lit("N/A")).alias("value"))


def gap_report(df: DataFrame, pivot_hour: int = 13) -> DataFrame:
    """Rows with session_gap's outputs (gap_*) -> one row per asset and day with a gap: its
    size, side, bucket, weekday, whether and in which hour it was filled, and the day's
    move from its open to its close."""
    edges = (0.2, 0.4, 0.6, 1.0, 2.0)
    out = df.groupBy(KEY, F.to_date(TS).alias("day")).agg(
        F.max("gap_gap_size").alias("gap_size"), F.bool_or("gap_gap_filled").alias("filled"),
        F.min(F.when(F.col("gap_gap_filled"), F.hour(TS))).alias("fill_hour"), F.min_by("o", TS).alias("open"), F.max_by("c", TS).alias("close"),
    ).where(F.col("gap_size").isNotNull() & (F.col("gap_size") != 0))
    return out.select(
        KEY, "day", "gap_size", F.when(F.col("gap_size") > 0, "up").otherwise("down").alias("side"), F.weekday("day").alias("weekday"),
        "filled", "fill_hour", (F.col("fill_hour") < pivot_hour).alias("filled_before_pivot"), ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("performance"),
        _bucket(F.abs(F.col("gap_size")), edges).alias("bucket"),
    )


def _bucket(size: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(f"over {edges[-1]}")
    for lo, hi in reversed([*zip((0.0, *edges), edges, strict=False)]):
        out = F.when(size < hi, f"{lo} to {hi}").otherwise(out)
    return out
