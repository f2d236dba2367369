"""Transforms across the assets of one timestamp. Rows with a null input take no part;
ties go to the smaller asset_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import AT, KEY, TS, W, fdiv, transform


def complete(df: DataFrame, x: str, assets: int | None = None) -> DataFrame:
    """The rows of those timestamps at which every asset has an x (the wide inner join)."""
    n = df.select(KEY).distinct().count() if assets is None else assets
    held = df.where(F.col(x).isNotNull())
    return held.withColumn("__n", F.count("*").over(AT())).where(F.col("__n") == n).drop("__n")


def _place(x, largest):
    return F.row_number().over(AT().orderBy(x.desc_nulls_last() if largest else x.asc_nulls_last(), F.col(KEY)))


def _mask(largest, percent):
    def made(s, x, k=10):
        n = F.count(x).over(AT())
        most = F.ceil(k * n / 100.0) if percent else F.greatest(F.lit(1), F.least(F.lit(k), n))
        return F.when(x.isNotNull(), _place(x, largest) <= most)

    return made


for _name, _largest in (("top", True), ("bottom", False)):
    transform(f"{_name}_k")(_mask(_largest, False))
    transform(f"{_name}_k_percent")(_mask(_largest, True))
transform("cs_rank")(lambda s, x, ascending=True: _place(x, not ascending).cast("double"))
transform("cs_zscore")(lambda s, x: fdiv(x - F.avg(x).over(AT()), F.stddev_samp(x).over(AT())))


@transform("cs_rank_quantile")
def cs_rank_quantile(s, x, ascending=True):
    """(those below + half of those equal) / all."""
    order = AT().orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    equal = F.count(x).over(Window.partitionBy(TS, x))
    return F.when(x.isNotNull(), (F.rank().over(order) - 1 + 0.5 * equal) / F.count(x).over(AT()))


@transform("cs_winsorize")
def cs_winsorize(s, x, lower_limit=0.05, upper_limit=0.95):
    lo, hi = F.percentile(x, lower_limit).over(AT()), F.percentile(x, upper_limit).over(AT())
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


@transform("cs_momentum")
def cs_momentum(s, returns):
    """The growth of the mean return of all assets, the same for each."""
    mean = s.add(F.avg(returns).over(AT()))
    return F.product(1 + mean).over(W().rowsBetween(Window.unboundedPreceding, 0))
