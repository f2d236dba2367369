"""The registered queries of the time-series library and their SQL.

Each runs transforms over whole tables. Figures are rounded to four places on both
sides, as sums differ in their last bits by order; times are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, operators  # noqa: F401
from .core import KEY, TS, apply, chain, on_valid
from .operators import grouped, reports, resample
from .plans import strategies
from .sources import feeds

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_ORDER_BARS = """bars AS (SELECT o_orderpriority asset_id, date_trunc('day', o_orderdate) ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) o, max(o_totalprice) h,
 min(o_totalprice) l, arg_max(o_totalprice, (o_orderdate, o_orderkey)) c, count(*)::double v FROM orders GROUP BY 1, 2)"""
_EVENT_BARS = """bars AS (SELECT event_type asset_id, date_trunc('hour', ts) ts, arg_min(value, (events.ts, event_id)) o, max(value) h,
 min(value) l, arg_max(value, (events.ts, event_id)) c, count(*)::double v FROM events GROUP BY 1, 2)"""
_W = "PARTITION BY asset_id ORDER BY ts"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _shown(df: DataFrame, *columns: str, key: tuple[str, ...] = (KEY, TS)) -> DataFrame:
    """Key and columns, times as text and doubles rounded."""

    def one(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
        return F.round(F.col(c), 4).alias(c) if kind == "double" else F.col(c)

    return df.select(*[one(c) for c in (*key, *columns)])


def _chain(df: DataFrame, *steps: tuple) -> DataFrame:
    return chain(df, *steps)


def _full(n: int, value: str, x: str = "c") -> str:
    frame = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({x}) OVER {frame} = {n} THEN {value} OVER {frame} END, 4)"


_T = "strftime(ts, '%Y-%m-%d %H:%M:%S') ts"


@query(f"""WITH {_ORDER_BARS}, m AS (SELECT asset_id, ts, {_full(10, 'avg(c)').replace('round(', '(').replace(', 4)', ')')} f, {_full(30, 'avg(c)').replace('round(', '(').replace(', 4)', ')')} s FROM bars),
p AS (SELECT *, lag(f) OVER ({_W}) f1, lag(s) OVER ({_W}) s1 FROM m)
SELECT asset_id, {_T}, coalesce(f > s AND f1 <= s1, false) enter_long, coalesce(s > f AND s1 <= f1, false) exit_long FROM p""")
def strategy_sma_crossover(spark, sf_dir):
    return _shown(strategies.sma_crossover(feeds.order_bars(spark, sf_dir)), "enter_long", "exit_long")


@query(f"WITH {_ORDER_BARS} SELECT asset_id, {_T}, round(o, 4) o, round(h, 4) h, round(l, 4) l, round(c, 4) c, v FROM bars")
def bars_daily(spark, sf_dir):
    return _shown(feeds.order_bars(spark, sf_dir), "o", "h", "l", "c", "v")


@query(f"WITH {_EVENT_BARS} SELECT asset_id, {_T}, round(o, 4) o, round(h, 4) h, round(l, 4) l, round(c, 4) c, v FROM bars")
def bars_hourly(spark, sf_dir):
    return _shown(feeds.event_bars(spark, sf_dir), "o", "h", "l", "c", "v")


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, {_full(14, 'avg(c)')} sma, {_full(14, 'max(c)')} mx, {_full(14, 'min(c)')} mn, {_full(14, 'sum(c)')} sm,
{_full(14, 'stddev_pop(c)')} sd, {_full(14, 'var_pop(c)').replace(', 4)', ', 0)')} vr, round(c - lag(c, 14) OVER ({_W}), 4) mom, round((c - lag(c, 14) OVER ({_W})) / lag(c, 14) OVER ({_W}), 4) roc,
round(({_full(20, 'avg(c)').replace('round(', '(').replace(', 4)', ')')} - 2 * {_full(20, 'stddev_pop(c)').replace('round(', '(').replace(', 4)', ')')}), 4) bb_lower FROM bars""")
def window_statistics(spark, sf_dir):
    out = _chain(
        feeds.order_bars(spark, sf_dir),
        ("sma", "sma", ("c",), {}), ("max", "mx", ("c",), {}), ("min", "mn", ("c",), {}), ("sum", "sm", ("c",), {}), ("stddev", "sd", ("c",), {}),
        ("var", "vr", ("c",), {}), ("mom", "mom", ("c",), {}), ("roc", "roc", ("c",), {}), ("bbands", "bb", ("c",), {"period": 20}),
    )
    out = _shown(out.withColumn("vr", F.round("vr", 0)), "sma", "mx", "mn", "sm", "sd", "vr", "mom", "roc", "bb_lower")
    return out


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, {_full(20, 'corr(c, o)', 'c')} cor, round({_full(20, 'covar_samp(c, o)').replace('round(', '(').replace(', 4)', ')')} / 1000, 1) cov,
round((c - {_full(20, 'avg(c)').replace('round(', '(').replace(', 4)', ')')}) / {_full(20, 'stddev_samp(c)').replace('round(', '(').replace(', 4)', ')')}, 4) z FROM bars""")
def window_pairs(spark, sf_dir):
    out = _chain(feeds.order_bars(spark, sf_dir), ("rolling_corr", "cor", ("c", "o"), {}), ("rolling_cov", "cov", ("c", "o"), {}), ("zscore", "z", ("c",), {}))
    return _shown(out.withColumn("cov", F.round(F.col("cov") / 1000, 1)), "cor", "cov", "z")


@query(f"""WITH {_ORDER_BARS}, i AS (SELECT *, row_number() OVER ({_W})::double i FROM bars)
SELECT asset_id, {_T}, {_full(14, 'regr_slope(c, i)')} slope, round({_full(14, 'avg(c)').replace('round(', '(').replace(', 4)', ')')} + {_full(14, 'regr_slope(c, i)').replace('round(', '(').replace(', 4)', ')')} * 6.5, 3) line FROM i""")
def window_regression(spark, sf_dir):
    out = _chain(feeds.order_bars(spark, sf_dir), ("linregslope", "slope", ("c",), {}), ("linreg", "line", ("c",), {}))
    return _shown(out.withColumn("line", F.round("line", 3)), "slope", "line")


@query(f"""WITH {_ORDER_BARS}, d AS (SELECT *, lag(c) OVER ({_W}) c1 FROM bars)
SELECT asset_id, {_T}, sum(coalesce(sign(c - c1) * v, 0)) OVER ({_W} ROWS UNBOUNDED PRECEDING) obv,
round(sum(CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) ad,
round(greatest(h - l, coalesce(abs(h - c1), 0), coalesce(abs(l - c1), 0)), 4) tr FROM d""")
def cumulative_volume(spark, sf_dir):
    return _shown(_chain(feeds.order_bars(spark, sf_dir), ("obv", "obv", (), {}), ("ad", "ad", (), {}), ("tr", "tr", (), {})), "obv", "ad", "tr")


@query(f"""WITH {_ORDER_BARS}, d AS (SELECT *, max(h) OVER w14 hi, min(l) OVER w14 lo, count(*) OVER w14 n FROM bars WINDOW w14 AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT asset_id, {_T}, round(CASE WHEN n = 14 AND hi <> lo THEN -100 * (hi - c) / (hi - lo) END, 4) willr,
{_full(14, 'avg((h + l + c) / 3)')} tp, round((o + h + l + c) / 4, 4) avgprice, round(CASE WHEN h = l THEN 0 ELSE (c - o) / (h - l) END, 4) bop FROM d""")
def price_oscillators(spark, sf_dir):
    out = _chain(feeds.order_bars(spark, sf_dir), ("willr", "willr", (), {}), ("typprice", "t", (), {}), ("sma", "tp", ("t",), {}), ("avgprice", "avgprice", (), {}), ("bop", "bop", (), {}))
    out = out.withColumn("willr", F.when(~F.isnan("willr"), F.col("willr")))
    return _shown(out, "willr", "tp", "avgprice", "bop")


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, round(sqrt(252 * {_full(14, 'avg(ln(h / l) ** 2)').replace('round(', '(').replace(', 4)', ')')} / (4 * ln(2))), 4) park,
round(sqrt(252 * {_full(14, 'avg(0.5 * ln(h / l) ** 2 - (2 * ln(2) - 1) * ln(c / o) ** 2)').replace('round(', '(').replace(', 4)', ')')}), 4) gk FROM bars""")
def volatility_estimators(spark, sf_dir):
    return _shown(_chain(feeds.order_bars(spark, sf_dir), ("parkinson", "park", (), {}), ("garman_klass", "gk", (), {})), "park", "gk")


@query(f"""WITH RECURSIVE {_ORDER_BARS}, i AS (SELECT *, row_number() OVER ({_W}) i FROM bars), e AS (SELECT asset_id, ts, i, c AS y FROM i WHERE i = 1 UNION ALL
SELECT i.asset_id, i.ts, i.i, e.y * (1 - 2.0 / 15) + i.c * (2.0 / 15) FROM e JOIN i ON i.asset_id = e.asset_id AND i.i = e.i + 1)
SELECT asset_id, {_T}, round(y, 4) ema FROM e""")
def ema_recurrence(spark, sf_dir):
    return _shown(apply(feeds.order_bars(spark, sf_dir), "ema", "ema", "c", period=14), "ema")


@query()
def recurrences(spark, sf_dir):
    """Indicators with memory; tested against plain loops."""
    names = ("rsi", "dema", "kama", "trix")
    out = feeds.order_bars(spark, sf_dir)
    for name in names:
        out = apply(out, name, name, "c")
    for name in ("atr", "adx", "psar", "macd"):
        out = apply(out, name, name, *(("c",) if name == "macd" else ()))
    return _shown(out, *names, "atr", "adx", "psar", "macd_macd", "macd_macd_signal")


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, c > o gt, c > lag(c) OVER ({_W}) prev, CASE WHEN c > o THEN h WHEN c <= o THEN l END pick, round(c - floor(c / 7) * 7, 4) md,
round(abs(c - o), 4) ab, floor(c) fl, round(sqrt(c), 4) sq, round(ln(c), 4) lg, (c > o) <> (h > o) xr, round((o + c + h) / 3, 4) mean3, greatest(o, c) mx FROM bars""")
def elementwise(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir)
    out = _chain(
        b, ("gt", "gt", ("c", "o"), {}), ("previous_gt", "prev", ("c",), {}), ("boolean_select_number", "pick", ("gt", "h", "l"), {}), ("modulo", "md", ("c", 7.0), {}),
        ("sub", "d", ("c", "o"), {}), ("abs", "ab", ("d",), {}), ("floor", "fl", ("c",), {}), ("sqrt", "sq", ("c",), {}), ("ln", "lg", ("c",), {}), ("gt", "ho", ("h", "o"), {}),
        ("logical_xor", "xr", ("gt", "ho"), {}), ("agg_mean", "mean3", ("o", "c", "h"), {}), ("agg_max", "mx", ("o", "c"), {}),
    )
    return out.select(KEY, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias(TS), "gt", "prev", "pick", F.round("md", 4).alias("md"), F.round("ab", 4).alias("ab"), "fl", F.round("sq", 4).alias("sq"), F.round("lg", 4).alias("lg"), "xr", F.round("mean3", 4).alias("mean3"), "mx")


@query(f"""WITH {_EVENT_BARS} SELECT asset_id, {_T}, row_number() OVER (PARTITION BY ts ORDER BY c DESC, asset_id) <= 2 top2, row_number() OVER (PARTITION BY ts ORDER BY c, asset_id)::double rnk,
round((c - avg(c) OVER t) / nullif(stddev_samp(c) OVER t, 0), 4) z,
round((rank() OVER (PARTITION BY ts ORDER BY c) - 1 + 0.5 * count(*) OVER (PARTITION BY ts, c)) / count(*) OVER t, 4) q FROM bars WINDOW t AS (PARTITION BY ts)""")
def cross_section(spark, sf_dir):
    out = _chain(feeds.event_bars(spark, sf_dir), ("top_k", "top2", ("c",), {"k": 2}), ("cs_rank", "rnk", ("c",), {}), ("cs_zscore", "z", ("c",), {}), ("cs_rank_quantile", "q", ("c",), {}))
    return _shown(out.withColumn("z", F.when(~F.isnan("z") & (F.abs("z") < 1e300), F.col("z"))), "top2", "rnk", "z", "q")


@query(f"""WITH {_ORDER_BARS}, k AS (SELECT *, month(ts) k FROM bars) SELECT asset_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') ts, k group_key, round(sum(c), 2) total, round(arg_max(c, ts), 4) last,
bool_and(c > o) all_up FROM k GROUP BY asset_id, k""")
def grouped_by_month(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir).withColumn("k", F.month(TS)).withColumn("up", F.col("c") > F.col("o"))
    one = grouped.groupby_numeric_agg(b, "k", "c", "sum").withColumn("value", F.round("value", 2)).withColumnRenamed("value", "total")
    two = grouped.groupby_numeric_agg(b, "k", "c", "last").withColumnRenamed("value", "last").drop(TS)
    three = grouped.groupby_boolean_agg(b, "k", "up", "AllOf").withColumnRenamed("value", "all_up").drop(TS)
    return _shown(one.join(two, [KEY, "group_key"]).join(three, [KEY, "group_key"]), "group_key", "total", "last", "all_up")


@query(f"""WITH {_ORDER_BARS}, r AS (SELECT *, last_day(ts)::timestamp m FROM bars) SELECT asset_id, strftime(m, '%Y-%m-%d %H:%M:%S') ts, round(arg_min(o, ts), 4) o, round(max(h), 4) h, round(min(l), 4) l,
round(arg_max(c, ts), 4) c, sum(v) v FROM r GROUP BY asset_id, m""")
def resample_month_end(spark, sf_dir):
    return _shown(resample.resample(feeds.order_bars(spark, sf_dir), "1ME"), "o", "h", "l", "c", "v")


@query(f"""WITH {_EVENT_BARS}, r AS (SELECT *, to_timestamp(ceil(epoch(ts) / 14400) * 14400)::timestamp m FROM bars) SELECT asset_id, strftime(m, '%Y-%m-%d %H:%M:%S') ts, round(arg_min(o, ts), 4) o, round(max(h), 4) h,
round(min(l), 4) l, round(arg_max(c, ts), 4) c, sum(v) v FROM r GROUP BY asset_id, m""")
def resample_four_hours(spark, sf_dir):
    return _shown(resample.resample(feeds.event_bars(spark, sf_dir), "4H"), "o", "h", "l", "c", "v")


@query(f"""WITH {_EVENT_BARS} SELECT asset_id, {_T}, isodow(ts) - 1 dow, dayofyear(ts) doy, week(ts) wk, isodow(ts) = 1 monday, floor((day(ts) - 1) / 7) = 1 second_week,
hour(ts) BETWEEN 9 AND 12 active FROM bars""")
def calendar(spark, sf_dir):
    out = _chain(
        feeds.event_bars(spark, sf_dir), ("index_datetime_extract", "dow", (), {"component": "day_of_week"}), ("index_datetime_extract", "doy", (), {"component": "day_of_year"}),
        ("index_datetime_extract", "wk", (), {"component": "week"}), ("day_of_week", "monday", (), {}), ("week_of_month", "second_week", (), {"week": "Second"}),
        ("time_of_day", "s", (), {"start": "09:00", "end": "12:00"}),
    )
    return _shown(out.withColumnRenamed("s_active", "active"), "dow", "doy", "wk", "monday", "second_week", "active")


@query("""SELECT p_partkey, upper(p_name) up, trim(p_type) tr, starts_with(p_brand, 'Brand#1') sw, regexp_full_match(p_name, '[A-Za-z]+') al, length(p_name) ln, reverse(p_brand) rv FROM part""")
def strings(spark, sf_dir):
    out = feeds.read(spark, sf_dir, "part")
    out = _chain(
        out, ("string_case", "up", ("p_name",), {}), ("string_trim", "tr", ("p_type",), {}), ("string_contains", "sw", ("p_brand",), {"operation": "starts_with", "pattern": "Brand#1"}),
        ("string_check", "al", ("p_name",), {}), ("string_length", "ln", ("p_name",), {}), ("string_reverse", "rv", ("p_brand",), {}),
    )
    return out.select("p_partkey", "up", "tr", "sw", "al", "ln", "rv")


@query(f"""WITH {_EVENT_BARS}, g AS (SELECT *, lag(c) OVER ({_W}) p FROM bars), f AS (SELECT *, CASE WHEN o > p THEN (o - l) / (o - p) WHEN o < p THEN (h - o) / (p - o) END b FROM g)
SELECT asset_id, {_T}, round((o - p) / p * 100, 4) gap_size, round(CASE WHEN p IS NOT NULL THEN CASE WHEN b >= 1 THEN b ELSE 0 END END, 4) gap_retrace, b * 100 >= 100 gap_filled FROM f""")
def bar_gaps(spark, sf_dir):
    out = apply(feeds.event_bars(spark, sf_dir), "bar_gap", "g")
    return _shown(out.select(KEY, TS, *[F.col(f"g_{x}").alias(x) for x in ("gap_size", "gap_retrace", "gap_filled")]), "gap_size", "gap_retrace", "gap_filled")


@query(f"""WITH {_ORDER_BARS}, a AS (SELECT asset_id, isodow(ts) - 1 lab, sum(c) s FROM bars GROUP BY 1, 2)
SELECT asset_id, lab "label", round(100 * s / sum(s) OVER (PARTITION BY asset_id), 4) "percent" FROM a""")
def report_pie(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir).withColumn("d", F.weekday(TS))
    return _shown(reports.pie_chart(b, "d", "c"), "label", "percent", key=(KEY,))


@query(f"""WITH {_ORDER_BARS}, e AS (SELECT asset_id, min(c) lo, max(c) hi FROM bars GROUP BY 1)
SELECT asset_id, least(floor((c - lo) / (hi - lo) * 10), 9)::int bin, count(*) "count" FROM bars JOIN e USING (asset_id) GROUP BY 1, 2""")
def report_histogram(spark, sf_dir):
    return reports.histogram(feeds.order_bars(spark, sf_dir), "c").select(KEY, "bin", "count")


@query(f"WITH {_ORDER_BARS} SELECT asset_id, round(avg(c), 4) mean, round(stddev_samp(c), 4) sd, round(quantile_cont(c, 0.25), 4) q1, round(arg_min(c, ts), 4) first FROM bars GROUP BY 1")
def report_cards(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir)
    out = reports.cards(b, "c", "mean").select(KEY, F.col("value").alias("mean"))
    for name, agg in (("sd", "stddev"), ("first", "first")):
        out = out.join(reports.cards(b, "c", agg).select(KEY, F.col("value").alias(name)), KEY)
    return _shown(out.join(reports.quantile_card(b, "c", 0.25).withColumnRenamed("value", "q1"), KEY), "mean", "sd", "q1", "first", key=(KEY,))


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, CASE WHEN count(*) OVER w = 11 AND h = max(h) OVER w AND l = min(l) OVER w THEN 3 WHEN count(*) OVER w = 11 AND h = max(h) OVER w THEN 2
WHEN count(*) OVER w = 11 AND l = min(l) OVER w THEN 1 ELSE 0 END pivot_type FROM bars WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def pivots(spark, sf_dir):
    return _shown(apply(feeds.order_bars(spark, sf_dir), "flexible_pivot_detector", "p").withColumnRenamed("p_pivot_type", "pivot_type"), "pivot_type")


@query(f"""WITH {_ORDER_BARS}, k AS (SELECT *, avg(h - l) OVER b sp, avg(abs(c - o)) OVER b bd, count(*) OVER b n FROM bars WINDOW b AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT asset_id, {_T}, CASE WHEN n = 10 THEN abs(c - o) <= 0.05 * sp END doji, CASE WHEN n = 10 THEN c > o AND abs(c - o) > 1.4 * bd WHEN c <= o THEN false END big FROM k""")
def candles(spark, sf_dir):
    return _shown(_chain(feeds.order_bars(spark, sf_dir), ("doji", "doji", (), {}), ("big_white_candle", "big", (), {})), "doji", "big")


@query(f"""WITH {_EVENT_BARS}, x AS (SELECT asset_id, ts, CASE WHEN v > 1 THEN c END c FROM bars), y AS (SELECT asset_id, ts, CASE WHEN count(c) OVER w = 5 THEN avg(c) OVER w END m FROM x WHERE c IS NOT NULL
WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT x.asset_id, strftime(x.ts, '%Y-%m-%d %H:%M:%S') ts, round(m, 4) m FROM x LEFT JOIN y ON x.asset_id = y.asset_id AND x.ts = y.ts""")
def null_compression(spark, sf_dir):
    b = feeds.event_bars(spark, sf_dir).withColumn("x", F.when(F.col("v") > 1, F.col("c")))
    return _shown(on_valid(b, "sma", "m", "x", period=5), "m")


@query(f"""WITH {_ORDER_BARS}, r AS (SELECT ts, c rc FROM bars WHERE asset_id = '1-URGENT') SELECT asset_id, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') ts, round(c / rc, 4) ratio FROM bars LEFT JOIN r ON bars.ts = r.ts""")
def reference_ratio(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir)
    out = feeds.with_reference(b, b, "IDX", "1-URGENT")
    return _shown(apply(out, "div", "ratio", "c", "`IDX:1-URGENT:c`"), "ratio")


_SWINGS = f"""k AS (SELECT *, row_number() OVER ({_W}) i, count(*) OVER (PARTITION BY asset_id) n, CASE WHEN count(*) OVER a = 10 AND h = max(h) OVER a THEN 1 WHEN count(*) OVER a = 10 AND l = min(l) OVER a THEN -1 END k
FROM bars WINDOW a AS ({_W} ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)), cand AS (SELECT *, lag(k) OVER ({_W}) pk FROM k WHERE k IS NOT NULL),
runs AS (SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER ({_W}) run FROM cand),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY asset_id, run ORDER BY CASE WHEN k = 1 THEN -h ELSE l END, ts) = 1),
ends AS (SELECT asset_id, arg_min(k, i) fk, arg_max(k, i) lk FROM best GROUP BY 1),
sw AS (SELECT k.asset_id, k.ts, k.o, k.h, k.l, k.c, k.i - 1 i, CASE WHEN k.i = k.n THEN -lk WHEN k.i = 1 THEN -fk ELSE best.k END hl FROM k LEFT JOIN ends USING (asset_id) LEFT JOIN best ON best.asset_id = k.asset_id AND best.ts = k.ts),
swings AS (SELECT *, CASE WHEN hl = 1 THEN h WHEN hl = -1 THEN l END lv FROM sw)"""


def _swings(spark, sf_dir):
    return apply(feeds.order_bars(spark, sf_dir), "swing_highs_lows", "s")


@query(f"WITH {_ORDER_BARS}, {_SWINGS} SELECT asset_id, {_T}, hl s_high_low, round(lv, 4) s_level FROM swings")
def swings(spark, sf_dir):
    return _shown(_swings(spark, sf_dir), "s_high_low", "s_level")


@query(f"""WITH {_ORDER_BARS}, {_SWINGS}, q AS (SELECT *, lag(hl) OVER w k0, lead(hl) OVER w k2, lead(hl, 2) OVER w k3, lag(lv) OVER w a, lead(lv) OVER w c2, lead(lv, 2) OVER w d FROM swings WHERE hl IS NOT NULL WINDOW w AS ({_W})),
m AS (SELECT *, CASE WHEN hl = 1 AND a < c2 AND c2 < lv AND lv < d THEN 1 WHEN hl = -1 AND a > c2 AND c2 > lv AND lv > d THEN -1 ELSE 0 END bos, CASE WHEN hl = 1 AND d > lv AND lv > a AND a > c2 THEN 1
WHEN hl = -1 AND d < lv AND lv < a AND a < c2 THEN -1 ELSE 0 END choch FROM q WHERE k0 = -hl AND k2 = -hl AND k3 = hl),
b AS (SELECT m.asset_id, m.ts, m.i, m.bos, m.choch, m.lv, min(s.i) j FROM m JOIN swings s ON s.asset_id = m.asset_id AND s.i >= m.i + 2 AND CASE WHEN m.hl = 1 THEN s.h > m.lv ELSE s.l < m.lv END WHERE m.bos + m.choch <> 0 GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, min(j) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nx FROM b) WHERE nx IS NULL OR j < nx)
SELECT s.asset_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') ts, coalesce(bos, 0) b_bos, coalesce(choch, 0) b_choch, round(coalesce(r.lv, 0), 4) b_level, coalesce(j, 0) b_broken_index FROM swings s LEFT JOIN r ON r.asset_id = s.asset_id AND r.ts = s.ts""")
def structure_breaks(spark, sf_dir):
    return _shown(apply(_swings(spark, sf_dir), "bos_choch", "b", "s_high_low", "s_level"), "b_bos", "b_choch", "b_level", "b_broken_index")


@query(f"""WITH {_EVENT_BARS}, d AS (SELECT asset_id, date_trunc('day', ts) r, max(h) dh, min(l) dl FROM bars GROUP BY 1, 2), p AS (SELECT asset_id, r, lag(r) OVER w pr, lag(dh) OVER w ph, lag(dl) OVER w pl FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY r)),
j AS (SELECT bars.*, pr, ph, pl FROM bars ASOF LEFT JOIN p ON bars.asset_id = p.asset_id AND bars.ts > p.r)
SELECT asset_id, {_T}, round(ph, 4) p_previous_high, round(pl, 4) p_previous_low, coalesce(bool_or(h > ph) OVER w, false) p_broken_high, coalesce(bool_or(l < pl) OVER w, false) p_broken_low
FROM j WINDOW w AS (PARTITION BY asset_id, pr ORDER BY ts)""")
def previous_day(spark, sf_dir):
    return _shown(apply(feeds.event_bars(spark, sf_dir), "previous_high_low", "p"), "p_previous_high", "p_previous_low", "p_broken_high", "p_broken_low")


@query()
def structure_levels(spark, sf_dir):
    """Retracements and liquidity; tested against plain loops."""
    out = _chain(_swings(spark, sf_dir), ("retracements", "r", ("s_high_low", "s_level"), {}), ("liquidity", "q", ("s_high_low", "s_level"), {"range_percent": 0.01}))
    return _shown(out, *[c for c in out.columns if c.startswith(("r_", "q_"))])
