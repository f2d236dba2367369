"""Candle patterns: booleans from bodies, wicks and their averages before the bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import W, transform

# The usual sizes relative to the average body or range.
DEFAULTS = {"period": 10, "body_none": 0.05, "body_short": 0.5, "body_long": 1.4, "wick_none": 0.05, "wick_long": 0.6, "near": 0.3}


class Candle:
    """The parts of the bar n rows back, measured against averages of the rows before it."""

    def __init__(self, s, n: int, k: dict) -> None:
        prices, before = [s.o, s.h, s.l, s.c], W().rowsBetween(-k["period"], -1)
        mean = lambda x: F.when(F.count(x).over(before) == k["period"], F.avg(x).over(before))
        means = s.once(("candle means", k["period"]), lambda: [mean(F.abs(s.c - s.o)), mean(s.h - s.l)])
        back = lambda xs: [F.lag(x, n).over(W()) for x in xs]
        if n:
            prices = s.once(("candle prices", n), lambda: back(prices))
            means = s.once(("candle means", k["period"], n), lambda: back(means))
        (self.o, self.h, self.l, self.c), (self.mean_body, self.mean_spread) = prices, means
        self.body = F.abs(self.c - self.o)
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.white, self.black = self.c > self.o, self.c < self.o
        self.no_body = self.body <= k["body_none"] * self.mean_spread
        self.short, self.long = self.body < k["body_short"] * self.mean_body, self.body > k["body_long"] * self.mean_body
        self.no_upper, self.no_lower = self.upper <= k["wick_none"] * self.mean_spread, self.lower <= k["wick_none"] * self.mean_spread
        self.long_upper, self.long_lower = self.upper >= k["wick_long"] * self.mean_spread, self.lower >= k["wick_long"] * self.mean_spread

    def above(self, other: Candle) -> F.Column:
        return self.bottom > other.top

    def below(self, other: Candle) -> F.Column:
        return self.top < other.bottom


def _pattern(name: str, bars: int = 1):
    def put(rule):
        def made(s, **options):
            k = DEFAULTS | options
            return rule(*[Candle(s, n, k) for n in range(bars)][::-1], k=k)

        transform(name)(made)
        return rule

    return put


# One bar
_pattern("doji")(lambda a, k: a.no_body)
_pattern("dragonfly_doji")(lambda a, k: a.no_body & a.no_upper & a.long_lower)
_pattern("gravestone_doji")(lambda a, k: a.no_body & a.no_lower & a.long_upper)
_pattern("four_price_doji")(lambda a, k: a.no_body & a.no_upper & a.no_lower)
_pattern("long_legged_doji")(lambda a, k: a.no_body & a.long_upper & a.long_lower)
_pattern("big_black_candle")(lambda a, k: a.black & a.long)
_pattern("big_white_candle")(lambda a, k: a.white & a.long)
_pattern("black_marubozu")(lambda a, k: a.black & a.long & a.no_upper & a.no_lower)
_pattern("white_marubozu")(lambda a, k: a.white & a.long & a.no_upper & a.no_lower)
_pattern("marubozu")(lambda a, k: a.long & a.no_upper & a.no_lower)
_pattern("spinning_top")(lambda a, k: a.short & (a.upper > a.body) & (a.lower > a.body))
# Two bars, the earlier first
_pattern("engulfing_bear", 2)(lambda a, b, k: a.white & b.black & (b.o >= a.c) & (b.c <= a.o) & b.long)
_pattern("engulfing_bull", 2)(lambda a, b, k: a.black & b.white & (b.o <= a.c) & (b.c >= a.o) & b.long)
_pattern("hammer", 2)(lambda a, b, k: b.short & b.long_lower & b.no_upper & (b.bottom <= a.l + k["near"] * a.mean_spread))
_pattern("hanging_man", 2)(lambda a, b, k: b.short & b.long_lower & b.no_upper & (b.bottom >= a.h - k["near"] * a.mean_spread))
_pattern("inverted_hammer", 2)(lambda a, b, k: b.short & b.long_upper & b.no_lower & b.below(a))
_pattern("shooting_star", 2)(lambda a, b, k: b.short & b.long_upper & b.no_lower & b.above(a))
_pattern("star", 2)(lambda a, b, k: a.long & b.short & ((a.white & b.above(a)) | (a.black & b.below(a))))
# Three bars
_pattern("abandoned_baby_bear", 3)(lambda a, b, c, k: a.white & a.long & b.no_body & (b.l > a.h) & c.black & (c.h < b.l))
_pattern("abandoned_baby_bull", 3)(lambda a, b, c, k: a.black & a.long & b.no_body & (b.h < a.l) & c.white & (c.l > b.h))
_pattern("evening_star", 3)(lambda a, b, c, k: a.white & a.long & b.short & b.above(a) & c.black & (c.c < (a.o + a.c) / 2))
_pattern("evening_doji_star", 3)(lambda a, b, c, k: a.white & a.long & b.no_body & b.above(a) & c.black & (c.c < (a.o + a.c) / 2))
_pattern("morning_star", 3)(lambda a, b, c, k: a.black & a.long & b.short & b.below(a) & c.white & (c.c > (a.o + a.c) / 2))
_pattern("morning_doji_star", 3)(lambda a, b, c, k: a.black & a.long & b.no_body & b.below(a) & c.white & (c.c > (a.o + a.c) / 2))
_pattern("three_black_crows", 3)(lambda a, b, c, k: a.black & b.black & c.black & a.long & b.long & c.long & (b.c < a.c) & (c.c < b.c) & (b.o < a.o) & (c.o < b.o) & (b.o > a.c) & (c.o > b.c))
_pattern("three_white_soldiers", 3)(lambda a, b, c, k: a.white & b.white & c.white & a.long & b.long & c.long & (b.c > a.c) & (c.c > b.c) & (b.o > a.o) & (c.o > b.o) & (b.o < a.c) & (c.o < b.c))
