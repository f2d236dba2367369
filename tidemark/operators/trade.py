"""Sinks: trade signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import KEY, TS, transform

transform("trade_executor_adapter")(lambda s, x: {"long": x > 0, "short": x < 0})


def trade_signals(df: DataFrame, enter_long: Column | None = None, enter_short: Column | None = None, exit_long: Column | None = None, exit_short: Column | None = None) -> DataFrame:
    """asset_id, ts and the connected signals under their names; at least one is needed."""
    given = {k: v for k, v in (("enter_long", enter_long), ("enter_short", enter_short), ("exit_long", exit_long), ("exit_short", exit_short)) if v is not None}
    if not given:
        raise ValueError("no signal is connected")
    return df.select(KEY, TS, *[F.coalesce(v, F.lit(False)).alias(k) for k, v in given.items()])
