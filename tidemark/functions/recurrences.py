"""Transforms with memory: moving averages and what is built of them.

All are columns around Steps.scan, the affine recurrence y = keep y + add; only
psar, decay and edecay need a state of another kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import CUM, REGISTRY, W, fdiv, full, rows, transform
from .windows import _flow, true_range


def emas(s, *chains: tuple[Column, float]) -> list[Column]:
    """Exponential averages of (x, period), each seeded with its first x."""
    return s.scan(*[(F.lit(1 - 2 / (n + 1)), x * (2 / (n + 1)), x) for x, n in chains])


def wilders_of(s, *chains: tuple[Column, int]) -> list[Column]:
    """Averages with weight 1/period, each seeded with its first full simple average."""
    held = [(s.add(x), n) for x, n in chains]
    return s.scan(*[(F.lit(1 - 1 / n), x / n, s.add(F.when(F.count(x).over(CUM()) == n, F.avg(x).over(rows(n))))) for x, n in held])


def sums_of(s, *chains: tuple[Column, int]) -> list[Column]:
    """Wilder's running sums: seeded with a sum over n - 1 rows, then y - y/n + x."""
    held = [(s.add(x), n) for x, n in chains]
    return s.scan(*[(F.lit(1 - 1 / n), x, s.add(F.when(F.count(x).over(CUM()) == n - 1, F.sum(x).over(CUM())))) for x, n in held])


def _from(s, n: int, x: Column) -> Column:
    """x from the n-th row on."""
    return F.when(s.add(s.index()) >= n, x)


transform("ema")(lambda s, x, period=14: emas(s, (x, period))[0])
transform("wilders")(lambda s, x, period=14: wilders_of(s, (x, period))[0])


@transform("dema")
def dema(s, x, period=14):
    (one,) = emas(s, (x, period))
    (two,) = emas(s, (one, period))
    return _from(s, 2 * period - 1, 2 * one - two)


@transform("tema")
def tema(s, x, period=14):
    (one,) = emas(s, (x, period))
    (two,) = emas(s, (one, period))
    (three,) = emas(s, (two, period))
    return _from(s, 3 * period - 2, 3 * one - 3 * two + three)


@transform("zlema")
def zlema(s, x, period=14):
    n = (period - 1) // 2
    back = s.add(s.lag(x, n))
    y = s.add(F.when(back.isNotNull(), 2 * x - back))
    a = 2 / (period + 1)
    seed = s.add(F.when(s.index() == n, x) if n else x)
    return s.scan((F.lit(1 - a), y * a, seed))[0]


@transform("kama")
def kama(s, x, period=14):
    d = s.add(F.abs(x - s.lag(x)))
    moved = full(period, F.sum(d), d)
    ratio = s.add(F.when(moved == 0, 1.0).otherwise(fdiv(F.abs(x - s.lag(x, period)), moved)))
    k = F.pow(ratio * (2 / 3 - 2 / 31) + 2 / 31, 2)
    return s.scan((1 - k, k * x, s.add(F.when(s.index() == period, x))))[0]


@transform("vidya")
def vidya(s, x, short_period=12, long_period=26, alpha=0.2):
    k = s.add(alpha * fdiv(full(short_period, F.stddev_pop(x), x), full(long_period, F.stddev_pop(x), x)))
    n = long_period - 1
    return s.scan((1 - k, k * x, s.add(F.when(s.index() == n, x))))[0]


def _decaying(factor, drop):
    def run(given):
        y = None
        for (x,) in given:
            y = x if y is None else max(x, y * factor - drop, 0 if drop else x)
            yield (y,)

    return run


transform("decay")(lambda s, x, period=14: s.machine(_decaying(1.0, 1 / period), [x], "y double")[0])
transform("edecay")(lambda s, x, period=14: s.machine(_decaying(1 - 1 / period, 0.0), [x], "y double")[0])


@transform("apo")
def apo(s, x, short_period=14, long_period=28):
    a, b = emas(s, (x, short_period), (x, long_period))
    return _from(s, 2, a - b)


@transform("ppo")
def ppo(s, x, short_period=14, long_period=28):
    a, b = emas(s, (x, short_period), (x, long_period))
    return _from(s, 2, fdiv(100 * (a - b), b))


@transform("macd")
def macd(s, x, short_period=12, long_period=26, signal_period=9):
    a, b = emas(s, (x, short_period), (x, long_period))
    line = s.add(_from(s, long_period, a - b))
    (signal,) = emas(s, (line, signal_period))
    return {"macd": line, "macd_signal": signal, "macd_histogram": line - signal}


@transform("trix")
def trix(s, x, period=14):
    (one,) = emas(s, (x, period))
    (two,) = emas(s, (one, period))
    (three,) = emas(s, (two, period))
    before = s.lag(three)
    return _from(s, 3 * period - 1, fdiv(100 * (three - before), three))


def _rsi(s, x, period):
    d = s.add(x - s.lag(x))
    up, down = wilders_of(s, (F.greatest(d, F.lit(0.0)) + 0 * d, period), (F.greatest(-d, F.lit(0.0)) + 0 * d, period))
    return fdiv(100 * up, up + down)


transform("rsi")(lambda s, x, period=14: _rsi(s, x, period))


@transform("stochrsi")
def stochrsi(s, x, period=14):
    r = s.add(_rsi(s, x, period))
    hi, lo = full(period, F.max(r), r), full(period, F.min(r), r)
    return F.when(hi == lo, 0.0).otherwise(fdiv(r - lo, hi - lo))


def _atr(s, period):
    return wilders_of(s, (true_range(s), period))[0]


transform("atr")(lambda s, period=14: _atr(s, period))
transform("natr")(lambda s, period=14: fdiv(100 * _atr(s, period), s.c))


def _moves(s):
    up, down = s.h - s.lag(s.h), s.lag(s.l) - s.l
    plus = F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0))
    minus = F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0))
    return s.add(plus), s.add(minus)


@transform("dm")
def dm(s, period=14):
    plus, minus = _moves(s)
    a, b = sums_of(s, (plus, period), (minus, period))
    return {"plus_dm": a, "minus_dm": b}


@transform("di")
def di(s, period=14):
    plus, minus = _moves(s)
    tr = s.add(F.when(plus.isNotNull(), true_range(s)))
    a, b, t = sums_of(s, (plus, period), (minus, period), (tr, period))
    return {"plus_di": fdiv(100 * a, t), "minus_di": fdiv(100 * b, t)}


def _dx(s, period):
    plus, minus = _moves(s)
    a, b = sums_of(s, (plus, period), (minus, period))
    return s.add(fdiv(100 * F.abs(a - b), a + b))


transform("dx")(lambda s, period=14: _dx(s, period))
transform("adx")(lambda s, period=14: wilders_of(s, (_dx(s, period), period))[0])


@transform("adxr")
def adxr(s, period=14):
    (x,) = wilders_of(s, (_dx(s, period), period))
    return 0.5 * (x + s.lag(x, period - 1))


@transform("mass")
def mass(s, period=14):
    (one,) = emas(s, (s.h - s.l, 9))
    (two,) = emas(s, (one, 9))
    ratio = s.add(_from(s, 17, fdiv(one, two)))
    return full(period, F.sum(ratio), ratio)


@transform("cvi")
def cvi(s, period=14):
    (x,) = emas(s, (s.h - s.l, period))
    old = s.lag(x, period)
    return _from(s, 2 * period, fdiv(100 * (x - old), old))


@transform("adosc")
def adosc(s, short_period=3, long_period=10):


    flow = s.add(F.sum(_flow(s)).over(CUM()))
    a, b = emas(s, (flow, short_period), (flow, long_period))
    return _from(s, long_period, a - b)


@transform("kvo")
def kvo(s, short_period=14, long_period=28):
    hlc = s.add(s.h + s.l + s.c)
    before = s.lag(hlc)
    trend = s.add(F.when(hlc > before, 1).when(hlc < before, -1))
    trend = s.add(F.last(trend, ignorenulls=True).over(CUM()))
    turned = s.add(F.coalesce((trend != F.lag(trend).over(W())), F.lit(True)).cast("int"))
    run = s.add(F.sum(turned).over(CUM()))
    wide = s.h - s.l
    first = W().partitionBy("asset_id", run)
    cm = s.add(F.sum(wide).over(first.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.first(s.add(s.lag(wide))).over(first.orderBy("ts")), F.lit(0.0)))
    force = s.add(F.when(trend.isNotNull(), s.v * trend * 100 * F.abs(2 * fdiv(wide, cm) - 1)))
    a, b = emas(s, (force, short_period), (force, long_period))
    return a - b


@transform("fisher")
def fisher(s, period=14):
    m = s.add((s.h + s.l) / 2)
    hi, lo = full(period, F.max(m), m), full(period, F.min(m), m)
    spread = F.when(hi == lo, 0.001).otherwise(hi - lo)
    raw = s.add(0.66 * (fdiv(m - lo, spread) - 0.5))

    def run(given):
        v = f = 0.0
        for (x,) in given:
            if x is None or x != x:
                yield (None, None)
                continue
            v = x + 0.67 * v
            v = 0.999 if v > 0.99 else -0.999 if v < -0.99 else v
            signal, f = f, 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * f
            yield (f, signal)

    a, b = s.machine(run, [raw], "fisher double,signal double")
    return {"fisher": a, "fisher_signal": b}


@transform("psar")
def psar(s, acceleration_factor_step=0.02, acceleration_factor_maximum=0.2):
    def run(given):
        sar, extreme, step, rising = None, None, acceleration_factor_step, True
        for i, (h, l) in enumerate(given):  # noqa: E741
            if i == 0:
                yield (None,)
                continue
            h1, l1 = given[i - 1]
            if i == 1:
                rising = h + l >= h1 + l1
                sar, extreme = (l1, h) if rising else (h1, l)
            else:
                sar += (extreme - sar) * step
                older = given[i - 2]
                sar = min(sar, l1, older[1]) if rising else max(sar, h1, older[0])
                if rising and h > extreme or not rising and l < extreme:
                    extreme, step = h if rising else l, min(step + acceleration_factor_step, acceleration_factor_maximum)
            if rising and l < sar or not rising and h > sar:
                rising, sar, step = not rising, extreme, acceleration_factor_step
                extreme = h if rising else l
            yield (sar,)

    return s.machine(run, [s.h, s.l], "psar double")[0]


@transform("ewm_cov")
def ewm_cov(s, x, y, span=20):
    return _ewm(s, x, y, span)[0]


@transform("ewm_corr")
def ewm_corr(s, x, y, span=20):
    cov, vx, vy = _ewm(s, x, y, span)
    return fdiv(cov, F.sqrt(vx * vy))


def _ewm(s, x, y, span):
    """Exponentially weighted moments, weights normalised over the rows so far."""
    keep = 1 - 2 / (span + 1)
    scans = s.scan(*[(F.lit(keep), z, z) for z in (F.lit(1.0) + 0 * x, x, y, x * y, x * x, y * y)])
    n, sx, sy, sxy, sxx, syy = scans
    mean = lambda z: z / n
    return mean(sxy) - mean(sx) * mean(sy), mean(sxx) - mean(sx) * mean(sx), mean(syy) - mean(sy) * mean(sy)


@transform("keltner_channels")
def keltner_channels(s, roll_period=20, band_multiplier=2.0):
    mid, width = emas(s, (s.c, roll_period), (true_range(s), roll_period))
    return {"upper_band": mid + band_multiplier * width, "lower_band": mid - band_multiplier * width}


@transform("chande_kroll_stop")
def chande_kroll_stop(s, p_period=10, q_period=20, multiplier=3.0):
    atr = _atr(s, p_period)
    high, low = s.add(full(p_period, F.max(s.h), s.h) - multiplier * atr), s.add(full(p_period, F.min(s.l), s.l) + multiplier * atr)
    return {"long_stop": full(q_period, F.min(low), low), "short_stop": full(q_period, F.max(high), high)}


@transform("elders_thermometer")
def elders_thermometer(s, period=13, buy_factor=0.5, sell_factor=0.5):
    out, under = F.abs(s.h - s.lag(s.h)), F.abs(s.lag(s.l) - s.l)
    heat = s.add(F.greatest(out, under))
    (ema,) = emas(s, (heat, period))
    return {"result": heat, "ema": ema, "buy_signal": heat < ema * buy_factor, "sell_signal": heat > ema * sell_factor}


@transform("qqe")
def qqe(s, avg_period=14, smooth_period=5, width_factor=4.236):
    r = s.add(_rsi(s, s.c, avg_period))
    (ma,) = emas(s, (r, smooth_period))
    change = s.add(F.abs(ma - s.lag(ma)))
    (one,) = emas(s, (change, 2 * avg_period - 1))
    (two,) = emas(s, (one, 2 * avg_period - 1))
    wide = two * width_factor

    def run(given):
        low = high = before = None
        for ma_, w in given:
            if ma_ is None or w is None or ma_ != ma_ or w != w:
                yield (None, None)
                continue
            a, b = ma_ - w, ma_ + w
            low = max(low, a) if low is not None and before > low and ma_ > low else a
            high = min(high, b) if high is not None and before < high and ma_ < high else b
            before = ma_
            yield (low, high)

    low, high = s.machine(run, [ma, wide], "low double,high double")
    return {"result": ma - 50, "rsi_ma": ma, "long_line": low, "short_line": high}


@transform("ma")
def ma(s, x, type="sma", period=14):  # noqa: A002
    if type not in ("sma", "ema", "hma", "kama", "dema", "tema", "trima", "wma", "zlema"):
        raise ValueError(f"no moving average {type}")
    return REGISTRY[type](s, x, period=period)


