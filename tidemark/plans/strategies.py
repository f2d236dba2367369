"""Example strategies as chains of transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions  # noqa: F401
from ..core import apply
from ..operators.trade import trade_signals


def sma_crossover(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """Long when the fast average crosses the slow one, out when it crosses back."""
    out = apply(apply(bars, "sma", "fast", "c", period=fast), "sma", "slow", "c", period=slow)
    out = apply(apply(out, "crossover", "up", "fast", "slow"), "crossunder", "down", "fast", "slow")
    return trade_signals(out, enter_long=F.col("up"), exit_long=F.col("down"))
