"""Transforms over finite and growing windows of an asset's rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import ALL, CUM, W, fdiv, full, rows, transform


def sma(x, n):
    return full(n, F.avg(x), x)


def true_range(s):
    """The first row's is its own range."""
    c1 = s.lag(s.c)
    return F.greatest(s.h - s.l, F.coalesce(F.abs(s.h - c1), F.lit(0.0)), F.coalesce(F.abs(s.l - c1), F.lit(0.0)))


# --- rolling statistics ---------------------------------------------------------------
transform("sma")(lambda s, x, period=14: sma(x, period))
transform("max")(lambda s, x, period=14: full(period, F.max(x), x))
transform("min")(lambda s, x, period=14: full(period, F.min(x), x))
transform("sum")(lambda s, x, period=14: full(period, F.sum(x), x))
transform("stddev")(lambda s, x, period=14: full(period, F.stddev_pop(x), x))
transform("stderr")(lambda s, x, period=14: full(period, F.stddev_pop(x), x) / math.sqrt(period))
transform("var")(lambda s, x, period=14: full(period, F.var_pop(x), x))
transform("mom")(lambda s, x, period=14: x - s.lag(x, period))
transform("roc")(lambda s, x, period=14: fdiv(x - s.lag(x, period), s.lag(x, period)))
transform("rocr")(lambda s, x, period=14: fdiv(x, s.lag(x, period)))
def _cross(s, a, b, how):
    """how(a, b, before a, before b) where there is a row before."""
    a1, b1 = s.lag(a), s.lag(b)
    return F.when(a1.isNotNull() & b1.isNotNull(), how(a, b, a1, b1))


transform("crossover")(lambda s, a, b: _cross(s, a, b, lambda x, y, x1, y1: (x > y) & (x1 <= y1)))
transform("crossunder")(lambda s, a, b: _cross(s, b, a, lambda x, y, x1, y1: (x > y) & (x1 <= y1)))
transform("crossany")(lambda s, a, b: _cross(s, a, b, lambda x, y, x1, y1: ((x > y) & (x1 <= y1)) | ((x < y) & (x1 >= y1))))
transform("cum_prod")(lambda s, x: F.product(x).over(CUM()))
transform("zscore")(lambda s, x, window=20: fdiv(x - sma(x, window), full(window, F.stddev_samp(x), x)))
transform("rolling_corr")(lambda s, x, y, window=20: full(window, F.corr(x, y), x + y))
transform("rolling_cov")(lambda s, x, y, window=20: full(window, F.covar_samp(x, y), x + y))
transform("beta")(lambda s, x, market, window=60: fdiv(full(window, F.covar_samp(x, market), x + market), full(window, F.var_samp(market), x + market)))
transform("forward_returns")(lambda s, x, period=1, return_type="simple": fdiv(F.lead(x, period).over(W()), x) - 1 if return_type == "simple" else F.log(F.lead(x, period).over(W()) / x))
transform("intraday_returns")(lambda s, return_type="simple": fdiv(s.c - s.o, s.o) if return_type == "simple" else F.log(s.c) - F.log(s.o))
transform("bband_percent")(lambda s, lower, upper: fdiv(s.c - lower, upper - lower))
transform("bband_width")(lambda s, lower, middle, upper: fdiv(upper - lower, middle))


@transform("winsorize")
def winsorize(s, x, lower_limit=0.05, upper_limit=0.95):
    """Clipped to quantiles of the asset's whole series (looks ahead)."""
    lo, hi = F.percentile(x, lower_limit).over(ALL()), F.percentile(x, upper_limit).over(ALL())
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


@transform("md")
def md(s, x, period=14):
    """Mean absolute deviation from the window's mean."""
    held = F.collect_list(x).over(rows(period))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q) / period
    got, m = s.add(held), sma(x, period)
    m = s.add(m)
    return F.when(m.isNotNull(), mean(F.transform(got, lambda y: F.abs(y - m))))


@transform("wma")
def wma(s, x, period=14):
    weights = [(period - i) * (x if i == 0 else s.lag(x, i)) for i in range(period)]
    return F.when(F.count(x).over(rows(period)) == period, sum(weights[1:], weights[0]) / (period * (period + 1) / 2))


@transform("trima")
def trima(s, x, period=14):
    one = (period + 1) // 2
    two = period // 2 + 1
    inner = s.add(sma(x, one))
    return sma(inner, two)


@transform("hma")
def hma(s, x, period=14):
    half, whole = s.add(wma(s, x, period // 2)), s.add(wma(s, x, period))
    return wma(s, s.add(2 * half - whole), int(math.sqrt(period)))


transform("vwma")(lambda s, x, v, period=14: fdiv(full(period, F.sum(x * v), x * v), full(period, F.sum(v), x * v)))


def _line(s, x, period):
    """Slope of x on 1..period, and its value at 0, over each full window."""
    i = s.add(s.index().cast("double"))
    slope = s.add(full(period, F.regr_slope(x, i), x))
    return slope, s.add(sma(x, period) - slope * (period + 1) / 2)


transform("linregslope")(lambda s, x, period=14: _line(s, x, period)[0])


@transform("linregintercept")
def linregintercept(s, x, period=14):
    """The line's value at the window's first row."""
    slope, zero = _line(s, x, period)
    return zero + slope


@transform("linreg")
def linreg(s, x, period=14):
    slope, zero = _line(s, x, period)
    return zero + slope * period


@transform("tsf")
def tsf(s, x, period=14):
    slope, zero = _line(s, x, period)
    return zero + slope * (period + 1)


@transform("fosc")
def fosc(s, x, period=14):
    ahead = s.add(tsf(s, x, period))
    return fdiv(100 * (x - s.lag(ahead)), x)


@transform("dpo")
def dpo(s, x, period=14):
    return s.lag(x, period // 2 + 1) - sma(x, period)


@transform("cmo")
def cmo(s, x, period=14):
    d = s.add(x - s.lag(x))
    up, down = full(period, F.sum(F.greatest(d, F.lit(0.0))), d), full(period, F.sum(F.greatest(-d, F.lit(0.0))), d)
    return fdiv(100 * (up - down), up + down)


@transform("vhf")
def vhf(s, x, period=14):
    d = s.add(F.abs(x - s.lag(x)))
    return fdiv(full(period, F.max(x), x) - full(period, F.min(x), x), full(period, F.sum(d), d))


@transform("msw")
def msw(s, x, period=14):
    """MESA sine wave: the phase of the window's main period."""
    at = lambda f: sum((f(2 * math.pi * i / period) * (x if i == 0 else s.lag(x, i)) for i in range(1, period)), F.lit(f(0.0)) * x)
    real, imaginary = s.add(at(math.cos)), s.add(at(math.sin))
    phase = F.when(F.abs(real) > 0.001, F.atan(imaginary / real)).otherwise(math.pi * F.when(imaginary < 0, -1.0).otherwise(1.0))
    phase = F.when(real < 0, phase + math.pi).otherwise(phase) + math.pi / 2
    phase = F.when(phase < 0, phase + 2 * math.pi).otherwise(phase)
    phase = s.add(F.when(phase > 2 * math.pi, phase - 2 * math.pi).otherwise(phase))
    return {"sine": F.sin(phase), "lead": F.sin(phase + math.pi / 4)}


@transform("volatility")
def volatility(s, x, period=14):
    r = s.add(fdiv(x, s.lag(x)) - 1)
    return full(period, F.stddev_pop(r), r) * math.sqrt(252)


@transform("return_vol")
def return_vol(s, period=14):
    r = s.add(fdiv(s.c, s.lag(s.c)) - 1)
    return full(period, F.stddev_samp(r), r)


@transform("price_diff_vol")
def price_diff_vol(s, period=14):
    r = s.add(s.c - s.lag(s.c))
    return full(period, F.stddev_samp(r), r)


@transform("bbands")
def bbands(s, x, period=14, stddev=2.0):
    mid, sd = sma(x, period), full(period, F.stddev_pop(x), x)
    return {"lower": mid - stddev * sd, "middle": mid, "upper": mid + stddev * sd}


# --- prices -----------------------------------------------------------------------------
transform("avgprice")(lambda s: (s.o + s.h + s.l + s.c) / 4)
transform("medprice")(lambda s: (s.h + s.l) / 2)
transform("typprice")(lambda s: (s.h + s.l + s.c) / 3)
transform("wcprice")(lambda s: (s.h + s.l + 2 * s.c) / 4)
transform("bop")(lambda s: F.when(s.h == s.l, 0.0).otherwise(fdiv(s.c - s.o, s.h - s.l)))
transform("marketfi")(lambda s: fdiv(s.h - s.l, s.v))
transform("tr")(lambda s: true_range(s))
transform("market_data_source")(lambda s: {x: getattr(s, x) for x in "ohlcv"})
transform("vwap")(lambda s: F.col("vw"))
transform("trade_count")(lambda s: F.col("n"))


@transform("ao")
def ao(s):
    m = (s.h + s.l) / 2
    return F.when(F.count(m).over(rows(34)) == 34, sma(m, 5) - sma(m, 34))


@transform("aroon")
def aroon(s, period=14):
    """Rows since the extreme of the last period + 1; the latest of equal ones."""
    i = s.add(s.index())
    n = rows(period + 1)
    whole = F.count("*").over(n) == period + 1
    since = lambda x: i - F.max_by(i, F.struct(x, i)).over(n)
    return {"down": F.when(whole, 100.0 * (period - since(-s.l)) / period), "up": F.when(whole, 100.0 * (period - since(s.h)) / period)}


@transform("aroonosc")
def aroonosc(s, period=14):
    a = aroon(s, period)
    return a["up"] - a["down"]


@transform("cci")
def cci(s, period=14):
    tp = s.add((s.h + s.l + s.c) / 3)
    dev = s.add(md(s, tp, period))
    return fdiv(tp - sma(tp, period), 0.015 * dev)


@transform("willr")
def willr(s, period=14):
    hi, lo = full(period, F.max(s.h), s.h), full(period, F.min(s.l), s.l)
    return fdiv(-100 * (hi - s.c), hi - lo)


@transform("stoch")
def stoch(s, k_period=14, k_slowing_period=3, d_period=3):
    hi, lo = full(k_period, F.max(s.h), s.h), full(k_period, F.min(s.l), s.l)
    fast = s.add(F.when(hi == lo, 0.0).otherwise(fdiv(100 * (s.c - lo), hi - lo)))
    k = s.add(sma(fast, k_slowing_period))
    d = s.add(sma(k, d_period))
    return {"k": F.when(d.isNotNull(), k), "d": d}


@transform("ultosc")
def ultosc(s, short_period=7, medium_period=14, long_period=28):
    c1 = s.lag(s.c)
    bp, tr = (s.add(F.when(c1.isNotNull(), x)) for x in (s.c - F.least(s.l, c1), F.greatest(s.h, c1) - F.least(s.l, c1)))
    part = lambda n: fdiv(full(n, F.sum(bp), bp), full(n, F.sum(tr), tr))
    return 100 * (4 * part(short_period) + 2 * part(medium_period) + part(long_period)) / 7


@transform("qstick")
def qstick(s, period=14):
    return sma(s.c - s.o, period)


# --- volume -----------------------------------------------------------------------------
def _flow(s):
    return F.when(s.h == s.l, 0.0).otherwise(fdiv((s.c - s.l) - (s.h - s.c), s.h - s.l) * s.v)


transform("ad")(lambda s: F.sum(_flow(s)).over(CUM()))


@transform("obv")
def obv(s):
    d = s.add(F.coalesce(F.signum(s.c - s.lag(s.c)) * s.v, F.lit(0.0)))
    return F.sum(d).over(CUM())


def _volume_index(s, rising):
    v1 = s.lag(s.v)
    turn = (s.v > v1) if rising else (s.v < v1)
    r = s.add(F.when(turn, fdiv(s.c, s.lag(s.c))).otherwise(1.0))
    return 1000 * F.product(r).over(CUM())


transform("nvi")(lambda s: _volume_index(s, False))
transform("pvi")(lambda s: _volume_index(s, True))


@transform("wad")
def wad(s):
    c1 = s.lag(s.c)
    d = s.add(F.when(s.c > c1, s.c - F.least(s.l, c1)).when(s.c < c1, s.c - F.greatest(s.h, c1)).when(c1.isNotNull(), 0.0))
    return F.when(d.isNotNull(), F.sum(d).over(CUM()))


@transform("emv")
def emv(s):
    return fdiv((s.h + s.l - s.lag(s.h) - s.lag(s.l)) / 2, fdiv(s.v / 10000, s.h - s.l))


@transform("mfi")
def mfi(s, period=14):
    tp = s.add((s.h + s.l + s.c) / 3)
    d = s.add(tp - s.lag(tp))
    flow = tp * s.v
    up, down = full(period, F.sum(F.when(d > 0, flow).otherwise(0.0)), d), full(period, F.sum(F.when(d < 0, flow).otherwise(0.0)), d)
    return fdiv(100 * up, up + down)


@transform("vosc")
def vosc(s, short_period=14, long_period=28):
    a, b = sma(s.v, short_period), sma(s.v, long_period)
    return fdiv(100 * (a - b), b)


# --- volatility estimators and channels ---------------------------------------------------
@transform("garman_klass")
def garman_klass(s, period=14, trading_days=252):
    x = s.add(0.5 * F.pow(F.log(s.h / s.l), 2) - (2 * math.log(2) - 1) * F.pow(F.log(s.c / s.o), 2))
    return F.sqrt(trading_days * sma(x, period))


@transform("parkinson")
def parkinson(s, period=14, trading_periods=252):
    x = s.add(F.pow(F.log(s.h / s.l), 2))
    return F.sqrt(trading_periods * sma(x, period) / (4 * math.log(2)))


@transform("yang_zhang")
def yang_zhang(s, period=14, trading_periods=252):
    night, day = s.add(F.log(s.o / s.lag(s.c))), s.add(F.log(s.c / s.o))
    up, down = F.log(s.h / s.o), F.log(s.l / s.o)
    rs = s.add(up * (up - day) + down * (down - day))
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    total = full(period, F.var_samp(night), night) + k * full(period, F.var_samp(day), day) + (1 - k) * sma(rs, period)
    return F.sqrt(total * trading_periods)


@transform("hodges_tompkins")
def hodges_tompkins(s, period=14, trading_periods=252):
    r = s.add(F.log(s.c / s.lag(s.c)))
    n = F.count(r).over(ALL()) - period + 1
    factor = 1 / (1 - period / n + (F.lit(period * period) - 1) / (3 * n * n))
    return full(period, F.stddev_samp(r), r) * math.sqrt(trading_periods) * factor


@transform("ulcer_index")
def ulcer_index(s, period=14, use_sum=False):
    fall = s.add(F.pow(100 * (s.c / full(period, F.max(s.c), s.c) - 1), 2))
    return F.sqrt(full(period, F.sum(fall) if use_sum else F.avg(fall), fall))


@transform("acceleration_bands")
def acceleration_bands(s, period=20, multiplier=2.0):
    wide = s.add(multiplier * fdiv(s.h - s.l, s.h + s.l))
    return {"upper_band": sma(s.h * (1 + wide), period), "middle_band": sma(s.c, period), "lower_band": sma(s.l * (1 - wide), period)}


@transform("donchian_channel")
def donchian_channel(s, window=20):
    hi, lo = full(window, F.max(s.h), s.h), full(window, F.min(s.l), s.l)
    return {"bbands_upper": hi, "bbands_middle": (hi + lo) / 2, "bbands_lower": lo}


@transform("ichimoku")
def ichimoku(s, tenkan=9, kijun=26, senkou=52, compat=False):
    """Spans are shown kijun rows ahead and the close kijun rows back, as plotted;
    compat shifts them the other way."""
    mid = lambda n: (full(n, F.max(s.h), s.h) + full(n, F.min(s.l), s.l)) / 2
    t, k, b = s.add(mid(tenkan)), s.add(mid(kijun)), s.add(mid(senkou))
    n = -kijun if compat else kijun
    return {"tenkan": t, "kijun": k, "senkou_a": s.lag((t + k) / 2, n), "senkou_b": s.lag(b, n), "chikou": s.lag(s.c, -n)}


@transform("pivot_point_sr")
def pivot_point_sr(s):
    p = (s.h + s.l + s.c) / 3
    return {
        "pivot": p, "resist_1": 2 * p - s.l, "support_1": 2 * p - s.h, "resist_2": p + s.h - s.l, "support_2": p - s.h + s.l,
        "resist_3": s.h + 2 * (p - s.l), "support_3": s.l - 2 * (s.h - p),
    }


@transform("price_distance")
def price_distance(s):
    return 2 * (s.h - s.l) + F.abs(s.o - s.lag(s.c)) - F.abs(s.c - s.o)


@transform("psl")
def psl(s, period=10):
    up = s.add((s.c > s.lag(s.c)).cast("double"))
    return 100 * sma(up, period)


@transform("vortex")
def vortex(s, period=14):
    tr = s.add(F.when(s.lag(s.c).isNotNull(), true_range(s)))
    a, b = s.add(F.abs(s.h - s.lag(s.l))), s.add(F.abs(s.l - s.lag(s.h)))
    total = full(period, F.sum(tr), tr)
    return {"plus_indicator": fdiv(full(period, F.sum(a), a), total), "minus_indicator": fdiv(full(period, F.sum(b), b), total)}


# --- gaps and pivots ------------------------------------------------------------------------
def _gap(s, gap_open, prior, prior_ts, run, fill_percent):
    """Fill and retracement of a gap over the rows of its run (a window by row order)."""
    size = gap_open - prior
    deepest = s.add(F.when(size > 0, F.min(s.l).over(run)).when(size < 0, F.max(s.h).over(run)))
    back = F.when(size != 0, F.greatest(fdiv(gap_open - deepest, size), F.lit(0.0)))
    return {"gap_filled": back * 100 >= fill_percent, "gap_retrace": back, "psc": prior, "psc_timestamp": prior_ts}


@transform("session_gap")
def session_gap(s, fill_percent=100):
    """The gap between a UTC day's first open and the close before, over that day."""
    day = s.add(F.to_date("ts"))
    prior, before = s.add(s.lag(s.c)), s.add(F.lag("ts").over(W()))
    start = s.add(F.lag(day).over(W()) != day)
    in_day = Window.partitionBy("asset_id", day).orderBy("ts")
    first = lambda x: s.add(F.first(x).over(in_day))
    opened, psc, at, real = first(s.o), first(prior), first(before), first(start)
    out = _gap(s, opened, psc, at, in_day.rowsBetween(Window.unboundedPreceding, 0), fill_percent)
    out["gap_size"] = F.when(start, fdiv(opened - psc, psc) * 100)
    return {k: F.when(real, x) for k, x in out.items()}


@transform("bar_gap")
def bar_gap(s, fill_percent=100, min_gap_size=0.0):
    prior = s.lag(s.c)
    size = fdiv(s.o - prior, prior) * 100
    back = F.when(s.o > prior, fdiv(s.o - s.l, s.o - prior)).when(s.o < prior, fdiv(s.h - s.o, prior - s.o))
    real = F.abs(size) >= min_gap_size
    out = {"gap_filled": back * 100 >= fill_percent, "gap_retrace": F.when(back >= 1, back).otherwise(0.0), "gap_size": size, "psc": prior, "psc_timestamp": F.lag("ts").over(W())}
    return {k: F.when(real, x) for k, x in out.items()}


@transform("flexible_pivot_detector")
def flexible_pivot_detector(s, left_count=5, right_count=5):
    """0 none, 1 low, 2 high, 3 both, among left_count rows before and right_count after."""
    around = W().rowsBetween(-left_count, right_count)
    whole = F.count("*").over(around) == left_count + right_count + 1
    high, low = whole & (s.h == F.max(s.h).over(around)), whole & (s.l == F.min(s.l).over(around))
    kind = s.add(F.when(high & low, 3).when(high, 2).when(low, 1).otherwise(0))
    return {"pivot_type": kind.cast("long"), "pivot_level": F.when(kind >= 2, s.h).when(kind == 1, s.l), "pivot_index": F.when(kind > 0, s.index() - 1).otherwise(-1).cast("long")}


@transform("fair_value_gap")
def fair_value_gap(s):
    """Three-row gaps; mitigated_index is the first later row that touches it, 0 if none."""
    up = (s.lag(s.h) < F.lead(s.l).over(W())) & (s.c > s.o)
    down = (s.lag(s.l) > F.lead(s.h).over(W())) & (s.c < s.o)
    kind = s.add(F.when(up, 1).when(down, -1))
    top = s.add(F.when(up, F.lead(s.l).over(W())).when(down, s.lag(s.l)))
    bottom = s.add(F.when(up, s.lag(s.h)).when(down, F.lead(s.h).over(W())))

    def touched(rows):
        found, waiting = [0] * len(rows), []
        for i, (kind, top, bottom, h, l) in enumerate(rows):  # noqa: E741
            rest = []
            for j, k, t, b in waiting:
                if i >= j + 2 and (l <= t if k == 1 else h >= b):
                    found[j] = i
                else:
                    rest.append((j, k, t, b))
            waiting = rest + ([(i, kind, top, bottom)] if kind == kind and kind else [])
        return [(x,) for x in found]

    (mitigated,) = s.machine(touched, [kind, top, bottom, s.h, s.l], "mitigated long")
    return {"fvg": kind.cast("long"), "top": top, "bottom": bottom, "mitigated_index": F.when(kind.isNotNull(), mitigated)}
