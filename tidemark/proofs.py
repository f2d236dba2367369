"""More registered queries: many transforms each over the whole table, with their SQL.

A query names its chain of transforms and, for each column it shows, the digits that
both sides round to and the SQL of its definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _EVENT_BARS, _ORDER_BARS, _SWINGS, _T, _W, _chain, query
from .core import KEY, TS
from .operators import futures, grouped, reports
from .sources import feeds

_BASE = {"orders": (feeds.order_bars, _ORDER_BARS), "events": (feeds.event_bars, _EVENT_BARS)}


def _cell(df: DataFrame, name: str, digits: int | None) -> Column:
    x, kind = F.col(name), dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind in ("double", "float"):  # no number: null on both sides
        return F.when(~F.isnan(x) & (F.abs(x) < 1e300), F.round(x, digits or 0)).alias(name)
    return x.alias(name)


def proved(name: str, base: str, steps: list[tuple], columns: list[tuple], ctes: str = "", source: str = "bars", recursive: bool = False) -> None:
    """Register a query of (transform, out, inputs, options) steps that shows columns of
    (name, digits or None, SQL)."""
    bars, sql = _BASE[base]
    shown = ", ".join(f'{x if d is None else f"round({x}, {d})"} AS "{c}"' for c, d, x in columns)
    text = f"WITH {'RECURSIVE ' if recursive else ''}{sql}{', ' + ctes if ctes else ''} SELECT asset_id, {_T}, {shown} FROM {source}"

    def run(spark, sf_dir):
        out = _chain(bars(spark, sf_dir), *steps)
        return out.select(KEY, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias(TS), *[_cell(out, c, d) for c, d, _ in columns])

    run.__name__ = name
    query(text)(run)


def over(n: int, agg: str, x: str = "c") -> str:
    """agg over the last n rows where all n have an x."""
    w = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg} OVER {w} END)"


def mean(n: int, x: str = "c") -> str:
    return over(n, f"avg({x})", x)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({_W})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def so_far(agg: str) -> str:
    return f"{agg} OVER ({_W} ROWS UNBOUNDED PRECEDING)"


# --- one row ------------------------------------------------------------------------------
_SCALARS = {"zero": "0", "one": "1", "negative_one": "-1", "pi": "pi()", "e": "exp(1)", "phi": "(1 + sqrt(5)) / 2", "sqrt2": "sqrt(2)", "sqrt3": "sqrt(3)", "sqrt5": "sqrt(5)", "ln2": "ln(2)", "ln10": "ln(10)", "log2e": "1 / ln(2)", "log10e": "1 / ln(10)"}
proved(
    "constants", "orders",
    [(k, k, (), {}) for k in _SCALARS] + [("bool_true", "bool_true", (), {}), ("bool_false", "bool_false", (), {}), ("number", "number", (), {"value": 2.5}), ("text", "text", (), {"value": "abc"}), ("timestamp_scalar", "timestamp_scalar", (), {"value": "2024-01-02 03:04:05"})]
    + [x for k in ("string", "number", "boolean", "timestamp") for x in ((f"null_{k}", f"n_{k}", (), {}), ("is_null", f"null_{k}", (f"n_{k}",), {}), ("is_valid", f"valid_{k}", (f"n_{k}",), {}))],
    [(k, 9, f"({x})::double") for k, x in _SCALARS.items()] + [("bool_true", None, "true"), ("bool_false", None, "false"), ("number", 4, "2.5::double"), ("text", None, "'abc'"), ("timestamp_scalar", None, "'2024-01-02 03:04:05'")]
    + [x for k in ("string", "number", "boolean", "timestamp") for x in ((f"null_{k}", None, "true"), (f"valid_{k}", None, "false"))],
)

_TRIG = {"acos": "acos(u)", "asin": "asin(u)", "atan": "atan(x)", "cos": "cos(x)", "cosh": "(exp(x) + exp(-x)) / 2", "sin": "sin(x)", "sinh": "(exp(x) - exp(-x)) / 2", "tan": "tan(u)", "tanh": "(exp(2 * x) - 1) / (exp(2 * x) + 1)", "exp": "exp(x)", "log10": "log10(x)", "todeg": "x * 180 / pi()", "torad": "x * pi() / 180"}
proved(
    "mathematics", "orders",
    [("div", "x", ("c", 100000.0), {}), ("div", "u", ("c", 1000000.0), {}), ("sub", "d", ("x", 1.5), {})] + [(k, k, ("u" if k in ("acos", "asin", "tan") else "x",), {}) for k in _TRIG]
    + [("ceil", "ceil", ("d",), {}), ("round", "round", ("d",), {}), ("trunc", "trunc", ("d",), {}), ("add", "add", ("x", "u"), {}), ("mul", "mul", ("x", "u"), {}), ("power_op", "power_op", ("x", 1.5), {})],
    [(k, 7, v) for k, v in _TRIG.items()] + [("ceil", 1, "ceil(x - 1.5)"), ("round", 1, "round(x - 1.5)"), ("trunc", 1, "trunc(x - 1.5)"), ("add", 8, "x + u"), ("mul", 7, "x * u"), ("power_op", 7, "pow(x, 1.5)")],
    "q AS (SELECT *, c / 100000.0 x, c / 1000000.0 u FROM bars)", "q",
)

_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}
proved(
    "comparisons", "orders",
    [(k, k, ("c", "o"), {}) for k in _OPS] + [(f"previous_{k}", f"previous_{k}", ("v",), {"periods": 2}) for k in _OPS]
    + [(f"highest_{k}", f"highest_{k}", ("v",), {"periods": 5}) for k in _OPS] + [(f"lowest_{k}", f"lowest_{k}", ("v",), {"periods": 5}) for k in _OPS],
    [(k, None, f"c {x} o") for k, x in _OPS.items()] + [(f"previous_{k}", None, f"v {x} {lag('v', 2)}") for k, x in _OPS.items()]
    + [(f"highest_{k}", None, f"v {x} {over(5, 'max(v)', 'v')}") for k, x in _OPS.items()] + [(f"lowest_{k}", None, f"v {x} {over(5, 'min(v)', 'v')}") for k, x in _OPS.items()],
)

_P, _Q = "(CASE WHEN v > 1 THEN c > o END)", "(h > l)"
proved(
    "logic", "orders",
    [("gt", "more", ("v", 1.0), {}), ("gt", "up", ("c", "o"), {}), ("gt", "wide", ("h", "l"), {}), ("null_boolean", "none", (), {}), ("boolean_select_boolean", "p", ("more", "up", "none"), {})]
    + [(k, k, ("p", "wide"), {}) for k in ("logical_and", "logical_or", "logical_and_not")]
    + [("logical_not", "logical_not", ("p",), {}), ("is_valid", "is_valid", ("p",), {}), ("is_null", "is_null", ("p",), {}), ("sub", "d", ("v", 1.0), {}), ("is_zero", "is_zero", ("d",), {}), ("is_one", "is_one", ("v",), {}),
       ("static_cast_to_integer", "as_integer", ("c",), {}), ("static_cast_to_boolean", "as_boolean", ("d",), {}), ("static_cast_to_decimal", "as_decimal", ("as_integer",), {}), ("static_cast_to_string", "as_string", ("as_integer",), {}), ("stringify", "stringify", ("more",), {}),
       ("alias_decimal", "alias_decimal", ("c",), {}), ("alias_boolean", "alias_boolean", ("up",), {}), ("alias_string", "alias_string", (KEY,), {}), ("alias_integer", "alias_integer", ("as_integer",), {}), ("alias_timestamp", "alias_timestamp", (TS,), {}),
       ("boolean_branch", "branch", ("up",), {}), ("div", "rate", ("c", "o"), {}), ("ratio_branch", "ratio", ("rate",), {}),
       ("agg_all_of", "all_of", ("up", "wide", "more"), {}), ("agg_any_of", "any_of", ("up", "wide", "more"), {}), ("agg_none_of", "none_of", ("up", "wide", "more"), {}), ("agg_all_equal", "all_equal", ("o", "h", "c"), {}), ("agg_all_unique", "all_unique", ("o", "l", "c"), {}),
       ("agg_sum", "agg_sum", ("o", "c", "v"), {}), ("agg_min", "agg_min", ("o", "c"), {})],
    [("logical_and", None, f"CASE WHEN {_P} IS NOT NULL THEN {_P} AND {_Q} END"), ("logical_or", None, f"CASE WHEN {_P} IS NOT NULL THEN {_P} OR {_Q} END"), ("logical_and_not", None, f"CASE WHEN {_P} IS NOT NULL THEN {_P} AND NOT {_Q} END"),
     ("logical_not", None, f"NOT {_P}"), ("is_valid", None, f"{_P} IS NOT NULL"), ("is_null", None, f"{_P} IS NULL"), ("is_zero", None, "v = 1"), ("is_one", None, "v = 1"), ("as_integer", None, "trunc(c)::bigint"), ("as_boolean", None, "v <> 1"), ("as_decimal", 2, "trunc(c)"),
     ("as_string", None, "trunc(c)::bigint::varchar"), ("stringify", None, "(v > 1)::varchar"), ("alias_decimal", 2, "c"), ("alias_boolean", None, "c > o"), ("alias_string", None, "asset_id"), ("alias_integer", None, "trunc(c)::bigint"), ("alias_timestamp", None, "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
     ("branch_true", None, "c > o"), ("branch_false", None, "NOT c > o"), ("ratio_high", None, "c / o > 1.5"), ("ratio_normal", None, "c / o BETWEEN 0.5 AND 1.5"), ("ratio_low", None, "c / o < 0.5"),
     ("all_of", None, "c > o AND h > l AND v > 1"), ("any_of", None, "c > o OR h > l OR v > 1"), ("none_of", None, "NOT (c > o OR h > l OR v > 1)"), ("all_equal", None, "o = h AND o = c"), ("all_unique", None, "o <> l AND o <> c AND l <> c"), ("agg_sum", 2, "o + c + v"), ("agg_min", 2, "least(o, c)")],
)

_KINDS = {"number": ("o", "c", "h"), "string": (KEY, "word", "other"), "boolean": ("up", "wide", "more"), "timestamp": (TS, "later", TS)}
_KIND_SQL = {"number": ("o", "c", "h"), "string": ("asset_id", "'w'", "'z'"), "boolean": ("(c > o)", "(h > l)", "(v > 1)"), "timestamp": ("ts", "TIMESTAMP '2030-01-01'", "ts")}


def _selected(kind: str) -> tuple[list, list]:
    (a, b, c), (x, y, z) = _KINDS[kind], _KIND_SQL[kind]
    text = (lambda s: f"strftime({s}, '%Y-%m-%d %H:%M:%S')") if kind == "timestamp" else (lambda s: s)
    digits = 2 if kind == "number" else None
    w = f"({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    steps = [
        (f"null_{kind}", f"gap_{kind}", (), {}), (f"boolean_select_{kind}", f"select_{kind}", ("up", a, b), {}), (f"conditional_select_{kind}", f"cond_{kind}", ("up", a, "more", b, c), {}),
        (f"conditional_select_{kind}", f"some_{kind}", ("more", a), {}), (f"first_non_null_{kind}", f"first_{kind}", (f"gap_{kind}", f"some_{kind}", b), {}),
        (f"lag_{kind}", f"lag_{kind}", (a,), {"period": 3}), (f"ffill_{kind}", f"ffill_{kind}", (f"some_{kind}",), {}), (f"percentile_select_{kind}", f"pct_{kind}", ("c", a, b), {"lookback": 7, "percentile": 60}),
        (f"switch2_{kind}", f"switch2_{kind}", ("slot2", a, b), {}), (f"switch3_{kind}", f"switch3_{kind}", ("slot3", a, b, c), {}), (f"switch4_{kind}", f"switch4_{kind}", ("slot4", a, b, c, a), {}), (f"switch5_{kind}", f"switch5_{kind}", ("slot5", a, b, c, a, b), {}),
    ]
    some = f"CASE WHEN v > 1 THEN {x} END"
    slots = [x, y, z, x, y]
    switch = lambda n: "CASE v::int % " + str(n) + " " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(slots[:n])) + " END"
    shown = [
        (f"select_{kind}", digits, text(f"(CASE WHEN c > o THEN {x} ELSE {y} END)")), (f"cond_{kind}", digits, text(f"(CASE WHEN c > o THEN {x} WHEN v > 1 THEN {y} ELSE {z} END)")), (f"first_{kind}", digits, text(f"coalesce({some}, {y})")),
        (f"lag_{kind}", digits, text(f"(lag({x}, 3) OVER ({_W}))")), (f"ffill_{kind}", digits, text(f"(last_value({some} IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING))")),
        (f"pct_{kind}", digits, text(f"(CASE WHEN count(c) OVER {w} = 7 THEN CASE WHEN c >= quantile_cont(c, 0.6) OVER {w} THEN {x} ELSE {y} END END)")),
        *[(f"switch{n}_{kind}", digits, text(f"({switch(n)})")) for n in range(2, 6)],
    ]
    return steps, shown


_BOTH = [_selected(k) for k in _KINDS]
proved(
    "selection", "orders",
    [("gt", "up", ("c", "o"), {}), ("gt", "wide", ("h", "l"), {}), ("gt", "more", ("v", 1.0), {}), ("text", "word", (), {"value": "w"}), ("text", "other", (), {"value": "z"}), ("timestamp_scalar", "later", (), {"value": "2030-01-01"})]
    + [("modulo", f"slot{n}", ("v", float(n)), {}) for n in range(2, 6)] + [x for s, _ in _BOTH for x in s],
    [x for _, s in _BOTH for x in s],
)

# --- windows ------------------------------------------------------------------------------
_LINE = over(14, "regr_slope(c, i)")
_WMA = lambda n, x: f"(CASE WHEN count({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN (" + " + ".join(f"{n - i} * {lag(x, i) if i else x}" for i in range(n)) + f") / {n * (n + 1) / 2} END)"
proved(
    "moving_averages", "orders",
    [("wma", "wma", ("c",), {"period": 9}), ("trima", "trima", ("c",), {"period": 9}), ("trima", "trima8", ("c",), {"period": 8}), ("hma", "hma", ("c",), {"period": 9}), ("vwma", "vwma0", ("c", "v"), {}), ("div", "vwma", ("vwma0", 99991.0), {}), ("linregintercept", "intercept", ("c",), {}), ("tsf", "tsf", ("c",), {}), ("fosc", "fosc", ("c",), {}),
     ("dpo", "dpo", ("c",), {}), ("ma", "ma", ("c",), {"type": "wma", "period": 5}), ("ao", "ao", (), {}), ("qstick", "qstick", (), {}), ("vosc", "vosc", (), {}), ("rocr", "rocr", ("c",), {}), ("stderr", "stderr", ("c",), {}), ("sub", "d1", ("c", "o"), {}), ("add", "d2", ("c", "o"), {}), ("div", "d3", ("d1", "d2"), {}), ("div", "d4", ("d3", 100.0), {}), ("add", "rate", ("d4", 1.0), {}), ("cum_prod", "cum_prod", ("rate",), {})],
    [("wma", 2, _WMA(9, "c")), ("trima", 4, mean(5, "t5")), ("trima8", 4, mean(5, "t4")), ("hma", 4, _WMA(3, "hm")), ("vwma", 7, div(over(14, "sum(c * v)"), over(14, "sum(v)")) + " / 99991.0"), ("intercept", 2, f"{mean(14)} - {_LINE} * 6.5"), ("tsf", 2, "ahead"), ("fosc", 4, f"100 * (c - {lag('ahead')}) / c"),
     ("dpo", 3, f"{lag('c', 8)} - {mean(14)}"), ("ma", 2, _WMA(5, "c")), ("ao", 5, f"CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 33 PRECEDING AND CURRENT ROW) = 34 THEN {mean(5, '(h + l) / 2')} - {mean(34, '(h + l) / 2')} END"), ("qstick", 3, mean(14, "c - o")), ("vosc", 4, f"100 * ({mean(14, 'v')} - {mean(28, 'v')}) / {mean(28, 'v')}"),
     ("rocr", 4, f"c / {lag('c', 14)}"), ("stderr", 2, f"{over(14, 'stddev_pop(c)')} / sqrt(14)"), ("cum_prod", 4, so_far("product(rate)"))],
    f"i AS (SELECT *, row_number() OVER ({_W})::double i, 1 + (c - o) / (c + o) / 100 rate FROM bars), j AS (SELECT *, {mean(5)} t5, {mean(4)} t4, 2 * {_WMA(4, 'c')} - {_WMA(9, 'c')} hm, {mean(14)} + {_LINE} * 7.5 ahead FROM i)", "j",
)

_TP = "((h + l + c) / 3)"


def _since(x: str) -> str:
    """Rows since the greatest of a list; of equal ones the latest."""
    return f"(list_position(list_reverse({x}), list_max({x})) - 1)"


_D14 = f"({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
_D15 = f"({_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"
proved(
    "oscillators", "orders",
    [("aroon", "aroon", (), {}), ("aroonosc", "aroonosc", (), {}), ("cci", "cci", (), {}), ("md", "md", ("c",), {}), ("cmo", "cmo", ("c",), {}), ("vhf", "vhf", ("c",), {}), ("stoch", "stoch", (), {}), ("ultosc", "ultosc", (), {}), ("psl", "psl", (), {}),
     ("medprice", "medprice", (), {}), ("wcprice", "wcprice", (), {}), ("crossany", "crossany", ("c", "o"), {}), ("msw", "msw", ("c",), {"period": 5})],
    [("aroon_up", 4, f"CASE WHEN len(hs) = 15 THEN 100.0 * (14 - {_since('hs')}) / 14 END"), ("aroon_down", 4, f"CASE WHEN len(hs) = 15 THEN 100.0 * (14 - {_since('ls')}) / 14 END"), ("aroonosc", 4, f"CASE WHEN len(hs) = 15 THEN 100.0 * ({_since('ls')} - {_since('hs')}) / 14 END"),
     ("cci", 3, "CASE WHEN len(tps) = 14 THEN " + div("tp - list_avg(tps)", "0.015 * list_avg(list_transform(tps, lambda x: abs(x - list_avg(tps))))") + " END"), ("md", 3, "CASE WHEN len(cs) = 14 THEN list_avg(list_transform(cs, lambda x: abs(x - list_avg(cs)))) END"),
     ("cmo", 4, div(f"100 * ({over(14, 'sum(greatest(d, 0))', 'd')} - {over(14, 'sum(greatest(-d, 0))', 'd')})", f"{over(14, 'sum(abs(d))', 'd')}")), ("vhf", 5, div(f"{over(14, 'max(c)')} - {over(14, 'min(c)')}", over(14, "sum(abs(d))", "d"))),
     ("stoch_k", 4, f"CASE WHEN {mean(3, 'k')} IS NOT NULL THEN k END"), ("stoch_d", 4, mean(3, "k")),
     ("ultosc", 4, "100 * (" + " + ".join(f"{m} * {div(over(n, 'sum(bp)', 'bp'), over(n, 'sum(rg)', 'rg'))}" for m, n in ((4, 7), (2, 14), (1, 28))) + ") / 7"), ("psl", 4, f"100 * {mean(10, 'up')}"),
     ("medprice", 4, "(h + l) / 2"), ("wcprice", 4, "(h + l + 2 * c) / 4"), ("crossany", None, "CASE WHEN c1 IS NOT NULL THEN (c > o AND c1 <= o1) OR (c < o AND c1 >= o1) END"), ("msw_sine", 5, "sin(phase)"), ("msw_lead", 5, "sin(phase + pi() / 4)")],
    f"""a AS (SELECT *, {_TP} tp, c - {lag('c')} d, {lag('c')} c1, {lag('o')} o1, list(h) OVER {_D15} hs, list(-l) OVER {_D15} ls, list({_TP}) OVER {_D14} tps, list(c) OVER {_D14} cs, c - least(l, {lag('c')}) bp0, greatest(h, {lag('c')}) - least(l, {lag('c')}) rg0, (c > {lag('c')})::int::double up0,
CASE WHEN {over(14, 'max(h)')} = {over(14, 'min(l)')} THEN 0 ELSE 100 * (c - {over(14, 'min(l)')}) / ({over(14, 'max(h)')} - {over(14, 'min(l)')}) END fast,
{' + '.join(f'cos(2 * pi() * {i} / 5) * ' + (lag('c', i) if i else 'c') for i in range(5))} re, {' + '.join(f'sin(2 * pi() * {i} / 5) * ' + (lag('c', i) if i else 'c') for i in range(5))} im FROM bars),
p AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN bp0 END bp, CASE WHEN c1 IS NOT NULL THEN rg0 END rg, CASE WHEN c1 IS NOT NULL THEN up0 END up, CASE WHEN abs(re) > 0.001 THEN atan(im / re) ELSE pi() * CASE WHEN im < 0 THEN -1 ELSE 1 END END f0 FROM a),
f AS (SELECT *, {mean(3, 'fast')} k, CASE WHEN re < 0 THEN f0 + pi() ELSE f0 END + pi() / 2 f1 FROM p), z AS (SELECT *, CASE WHEN f1 < 0 THEN f1 + 2 * pi() WHEN f1 > 2 * pi() THEN f1 - 2 * pi() ELSE f1 END phase FROM f)""", "z",
)

proved(
    "volume_indices", "orders",
    [("nvi", "nvi", (), {}), ("pvi", "pvi", (), {}), ("ln", "ln_nvi", ("nvi",), {}), ("ln", "ln_pvi", ("pvi",), {}), ("wad", "wad", (), {}), ("emv", "emv0", (), {}), ("div", "emv", ("emv0", 1e10), {}), ("mfi", "mfi", (), {}), ("marketfi", "marketfi", (), {}), ("market_data_source", "bar", (), {}), ("price_distance", "distance", (), {}), ("trade_executor_adapter", "trade", ("v",), {})],
    [("ln_nvi", 6, f"ln(1000 * {so_far('product(fall)')})"), ("ln_pvi", 6, f"ln(1000 * {so_far('product(rise)')})"), ("wad", 2, "CASE WHEN c1 IS NOT NULL THEN " + so_far("sum(CASE WHEN c > c1 THEN c - least(l, c1) WHEN c < c1 THEN c - greatest(h, c1) ELSE 0 END * (c1 IS NOT NULL)::int)") + " END"),
     ("emv", 2, "CASE WHEN h > l THEN (h + l - h1 - l1) / 2 / (v / 10000 / (h - l)) / 1e10 WHEN h1 IS NOT NULL THEN 0 END"), ("mfi", 4, div(f"100 * {over(14, 'sum(CASE WHEN d > 0 THEN tp * v ELSE 0 END)', 'd')}", over(14, "sum(CASE WHEN d <> 0 THEN tp * v ELSE 0 END)", "d"))), ("marketfi", 4, "(h - l) / v"),
     *[(f"bar_{x}", 2, x) for x in "ohlcv"], ("distance", 2, "2 * (h - l) + abs(o - c1) - abs(c - o)"), ("trade_long", None, "v > 0"), ("trade_short", None, "v < 0")],
    f"""a AS (SELECT *, {lag('c')} c1, {lag('v')} v1, {lag('h')} h1, {lag('l')} l1, {_TP} tp FROM bars), b AS (SELECT *, tp - {lag('tp')} d, CASE WHEN v < v1 THEN c / c1 ELSE 1 END fall, CASE WHEN v > v1 THEN c / c1 ELSE 1 END rise FROM a)""", "b",
)

proved(
    "volatility_and_channels", "orders",
    [("volatility", "volatility", ("c",), {}), ("return_vol", "return_vol", (), {}), ("price_diff_vol", "diff_vol", (), {}), ("yang_zhang", "yz", (), {}), ("hodges_tompkins", "ht", (), {}), ("ulcer_index", "ulcer", (), {}), ("acceleration_bands", "acc", (), {}), ("donchian_channel", "don", (), {}),
     ("ichimoku", "ichi", (), {}), ("pivot_point_sr", "pp", (), {}), ("vortex", "vx", (), {}), ("bbands", "bb", ("c",), {"period": 20}), ("bband_percent", "bbp", ("bb_lower", "bb_upper"), {}), ("bband_width", "bbw", ("bb_lower", "bb_middle", "bb_upper"), {}), ("beta", "beta", ("c", "o"), {"window": 30}),
     ("forward_returns", "fwd", ("c",), {"period": 2}), ("intraday_returns", "intra", (), {}), ("forward_returns", "fwd_log", ("c",), {"return_type": "log"}), ("winsorize", "wins", ("c",), {"lower_limit": 0.1, "upper_limit": 0.9})],
    [("volatility", 4, over(14, "stddev_pop(r)", "r") + " * sqrt(252)"), ("return_vol", 5, over(14, "stddev_samp(r)", "r")), ("diff_vol", 1, over(14, "stddev_samp(d)", "d")),
     ("yz", 4, f"sqrt(252 * ({over(14, 'var_samp(night)', 'night')} + {0.34 / (1.34 + 15 / 13)} * {over(14, 'var_samp(inday)', 'inday')} + {1 - 0.34 / (1.34 + 15 / 13)} * {mean(14, 'rs')}))"),
     ("ht", 4, over(14, "stddev_samp(lr)", "lr") + " * sqrt(252) / (1 - 14.0 / n + 195.0 / (3 * n * n))"), ("ulcer", 4, "sqrt(" + mean(14, "fall") + ")"), ("acc_upper_band", 1, mean(20, "h * (1 + 2 * (h - l) / (h + l))")), ("acc_middle_band", 4, mean(20, "c")), ("acc_lower_band", 1, mean(20, "l * (1 - 2 * (h - l) / (h + l))")),
     ("don_bbands_upper", 2, over(20, "max(h)")), ("don_bbands_middle", 4, f"({over(20, 'max(h)')} + {over(20, 'min(l)')}) / 2"), ("don_bbands_lower", 2, over(20, "min(l)")),
     ("ichi_tenkan", 4, "t9"), ("ichi_kijun", 4, "t26"), ("ichi_senkou_a", 4, lag("(t9 + t26) / 2", 26)), ("ichi_senkou_b", 4, lag("t52", 26)), ("ichi_chikou", 2, f"lead(c, 26) OVER ({_W})"),
     ("pp_pivot", 3, "tp"), ("pp_resist_1", 3, "2 * tp - l"), ("pp_support_1", 3, "2 * tp - h"), ("pp_resist_2", 3, "tp + h - l"), ("pp_support_2", 3, "tp - h + l"), ("pp_resist_3", 3, "h + 2 * (tp - l)"), ("pp_support_3", 3, "l - 2 * (h - tp)"),
     ("vx_plus_indicator", 4, div(over(14, "sum(abs(h - l1))", "l1"), over(14, "sum(rng)", "l1"))), ("vx_minus_indicator", 4, div(over(14, "sum(abs(l - h1))", "l1"), over(14, "sum(rng)", "l1"))),
     ("bbp", 4, div(f"c - ({mean(20)} - 2 * {over(20, 'stddev_pop(c)')})", f"4 * {over(20, 'stddev_pop(c)')}")), ("bbw", 4, div(f"4 * {over(20, 'stddev_pop(c)')}", mean(20))), ("beta", 4, div(over(30, "covar_samp(c, o)"), over(30, "var_samp(o)"))),
     ("fwd", 5, f"lead(c, 2) OVER ({_W}) / c - 1"), ("intra", 5, "(c - o) / o"), ("fwd_log", 5, f"ln(lead(c) OVER ({_W}) / c)"), ("wins", 3, "least(greatest(c, q1), q9)")],
    f"""e AS (SELECT asset_id, quantile_cont(c, 0.1) q1, quantile_cont(c, 0.9) q9, count(*) - 14.0 n FROM bars GROUP BY 1), a AS (SELECT bars.*, q1, q9, n, {_TP} tp, {lag('c')} c1, {lag('h')} h1, {lag('l')} l1, {lag('bars.c')} x FROM bars JOIN e USING (asset_id)),
b AS (SELECT *, c / c1 - 1 r, c - c1 d, ln(o / c1) night, ln(c / o) inday, ln(h / o) * (ln(h / o) - ln(c / o)) + ln(l / o) * (ln(l / o) - ln(c / o)) rs, ln(c / c1) lr, pow(100 * (c / {over(14, 'max(c)')} - 1), 2) fall, greatest(h - l, abs(h - c1), abs(l - c1)) rng,
{', '.join(f"({over(n, 'max(h)')} + {over(n, 'min(l)')}) / 2 t{n}" for n in (9, 26, 52))} FROM a)""", "b",
)

# --- candles --------------------------------------------------------------------------------
# Each bar's parts: averages of the ten bars before it, and short names for its shape.
_PARTS = f"""k AS (SELECT *, CASE WHEN count(*) OVER b = 10 THEN avg(h - l) OVER b END sp, CASE WHEN count(*) OVER b = 10 THEN avg(abs(c - o)) OVER b END bd FROM bars WINDOW b AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, greatest(o, c) top, least(o, c) bot, abs(c - o) body, c > o white, c < o black, abs(c - o) <= 0.05 * sp nobody, abs(c - o) < 0.5 * bd short, abs(c - o) > 1.4 * bd long_, h - greatest(o, c) <= 0.05 * sp noup, least(o, c) - l <= 0.05 * sp nolow,
h - greatest(o, c) >= 0.6 * sp longup, least(o, c) - l >= 0.6 * sp longlow FROM k),
t AS (SELECT *, {', '.join(f'lag({x}, {n}) OVER ({_W}) {x}{n}' for n in (1, 2) for x in ('o', 'h', 'l', 'c', 'top', 'bot', 'sp', 'white', 'black', 'nobody', 'short', 'long_'))} FROM s)"""
_CANDLES = {
    "dragonfly_doji": "nobody AND noup AND longlow", "gravestone_doji": "nobody AND nolow AND longup", "four_price_doji": "nobody AND noup AND nolow", "long_legged_doji": "nobody AND longup AND longlow",
    "big_black_candle": "black AND long_", "black_marubozu": "black AND long_ AND noup AND nolow", "white_marubozu": "white AND long_ AND noup AND nolow", "marubozu": "long_ AND noup AND nolow", "spinning_top": "short AND h - top > body AND bot - l > body",
    "engulfing_bear": "white1 AND black AND o >= c1 AND c <= o1 AND long_", "engulfing_bull": "black1 AND white AND o <= c1 AND c >= o1 AND long_", "hammer": "short AND longlow AND noup AND bot <= l1 + 0.3 * sp1", "hanging_man": "short AND longlow AND noup AND bot >= h1 - 0.3 * sp1",
    "inverted_hammer": "short AND longup AND nolow AND top < bot1", "shooting_star": "short AND longup AND nolow AND bot > top1", "star": "long_1 AND short AND ((white1 AND bot > top1) OR (black1 AND top < bot1))",
    "abandoned_baby_bear": "white2 AND long_2 AND nobody1 AND l1 > h2 AND black AND h < l1", "abandoned_baby_bull": "black2 AND long_2 AND nobody1 AND h1 < l2 AND white AND l > h1",
    "evening_star": "white2 AND long_2 AND short1 AND bot1 > top2 AND black AND c < (o2 + c2) / 2", "evening_doji_star": "white2 AND long_2 AND nobody1 AND bot1 > top2 AND black AND c < (o2 + c2) / 2",
    "morning_star": "black2 AND long_2 AND short1 AND top1 < bot2 AND white AND c > (o2 + c2) / 2", "morning_doji_star": "black2 AND long_2 AND nobody1 AND top1 < bot2 AND white AND c > (o2 + c2) / 2",
    "three_black_crows": "black2 AND black1 AND black AND long_2 AND long_1 AND long_ AND c1 < c2 AND c < c1 AND o1 < o2 AND o < o1 AND o1 > c2 AND o > c1", "three_white_soldiers": "white2 AND white1 AND white AND long_2 AND long_1 AND long_ AND c1 > c2 AND c > c1 AND o1 > o2 AND o > o1 AND o1 < c2 AND o < c1",
}
_LOOSE = {"body_long": 0.7, "body_short": 0.9, "body_none": 0.2, "wick_none": 0.3, "wick_long": 0.25, "near": 0.8, "period": 4}
_LOOSE_PARTS = _PARTS.replace("= 10", "= 4").replace("10 PRECEDING", "4 PRECEDING").replace("0.05 * sp nobody", "0.2 * sp nobody").replace("0.05 * sp", "0.3 * sp").replace("0.5 * bd", "0.9 * bd").replace("1.4 * bd", "0.7 * bd").replace("0.6 * sp", "0.25 * sp")
for _base in ("orders", "events"):
    proved(f"candles_{_base}", _base, [(k, k, (), {}) for k in _CANDLES], [(k, None, x) for k, x in _CANDLES.items()], _PARTS, "t")
    proved(f"candles_loose_{_base}", _base, [(k, k, (), _LOOSE) for k in _CANDLES], [(k, None, x.replace("0.3 * sp1", "0.8 * sp1")) for k, x in _CANDLES.items()], _LOOSE_PARTS, "t")


# --- with memory ------------------------------------------------------------------------------
def remembered(name: str, source: str, inputs: list[str], states: list[tuple[str, str, str]]) -> str:
    """A recursive CTE over source's rows i = 1, 2, ...: states of (name, seed, step). A seed
    may be null, and then stands for the row that follows; {s} is a state's new value,
    p.s its value before, n.x the row's input."""
    first, then = {}, {}
    for s, seed, step in states:
        first[s] = f"({seed.format(**first)})"
        then[s] = f"(CASE WHEN p.{s} IS NULL THEN {seed.format(**then)} ELSE {step.format(**then)} END)"
    kept = "".join(f", n.{x}" for x in inputs)
    return (
        f"{name} AS (SELECT n.asset_id, n.ts, n.i{kept}, {', '.join(f'({x})::double {s}' for s, x in first.items())} FROM {source} n WHERE n.i = 1 UNION ALL "
        f"SELECT n.asset_id, n.ts, n.i{kept}, {', '.join(f'({x})::double' for x in then.values())} FROM {name} p JOIN {source} n ON n.asset_id = p.asset_id AND n.i = p.i + 1)"
    )


def ema_state(s: str, x: str, n: int, seed: str | None = None) -> tuple[str, str, str]:
    a = 2 / (n + 1)
    return s, seed or x, f"{1 - a!r} * p.{s} + {a!r} * {x}"


_TR = "greatest(h - l, coalesce(abs(h - c1), 0), coalesce(abs(l - c1), 0))"
_ROWS = f"i0 AS (SELECT *, row_number() OVER ({_W}) i, {lag('c')} c1, {lag('h')} h1, {lag('l')} l1, h - l hl, {_TP} tp FROM bars)"
_FLOW = "CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END"
proved(
    "exponential_averages", "orders",
    [("dema", "dema", ("c",), {}), ("tema", "tema", ("c",), {}), ("trix", "trix", ("c",), {}), ("apo", "apo", ("c",), {}), ("ppo", "ppo", ("c",), {}), ("macd", "macd", ("c",), {}), ("mass", "mass", (), {}), ("cvi", "cvi", (), {}), ("keltner_channels", "kelt", (), {}), ("zlema", "zlema", ("c",), {}),
     ("elders_thermometer", "heat", (), {}), ("adosc", "adosc", (), {}), ("ewm_cov", "cov0", ("c", "o"), {}), ("div", "ewm_cov", ("cov0", 1e6), {}), ("ewm_corr", "ewm_corr", ("c", "h"), {})],
    [("dema", 2, "CASE WHEN i >= 27 THEN 2 * e1 - e2 END"), ("tema", 2, "CASE WHEN i >= 40 THEN 3 * e1 - 3 * e2 + e3 END"), ("trix", 4, f"CASE WHEN i >= 41 THEN 100 * (e3 - {lag('e3')}) / e3 END"), ("apo", 2, "CASE WHEN i >= 2 THEN e1 - e28 END"), ("ppo", 4, "CASE WHEN i >= 2 THEN 100 * (e1 - e28) / e28 END"),
     ("macd_macd", 2, "line"), ("macd_macd_signal", 2, "sig"), ("macd_macd_histogram", 2, "line - sig"), ("mass", 4, over(14, "sum(ratio)", "ratio")), ("cvi", 3, f"CASE WHEN i >= 28 AND {lag('r14', 14)} > 0 THEN 100 * (r14 - {lag('r14', 14)}) / {lag('r14', 14)} END"),
     ("kelt_upper_band", 2, "k20 + 2 * t20"), ("kelt_lower_band", 2, "k20 - 2 * t20"), ("zlema", 2, "CASE WHEN i >= 6 THEN z END"), ("heat_result", 2, "hx"), ("heat_ema", 2, "h13"), ("heat_buy_signal", None, "hx < h13 * 0.5"), ("heat_sell_signal", None, "hx > h13 * 0.5"), ("adosc", 2, "CASE WHEN i >= 10 THEN a3 - a10 END"),
     ("ewm_cov", 2, "(sxy / w - sx / w * sy / w) / 1e6"), ("ewm_corr", 3, "(sxh / w - sx / w * sh / w) / nullif(sqrt((sxx / w - sx / w * sx / w) * (shh / w - sh / w * sh / w)), 0)")],
    f"{_ROWS}, i1 AS (SELECT *, {so_far(f'sum({_FLOW})')} ad, {_TR} tr, greatest(abs(h - h1), abs(l1 - l)) hx, 2 * c - {lag('c', 6)} zx FROM i0), "
    + remembered("r", "i1", ["hx", "c"], [
        ema_state("e1", "n.c", 14), ema_state("e2", "{e1}", 14), ema_state("e3", "{e2}", 14), ema_state("e28", "n.c", 28), ema_state("e12", "n.c", 12), ema_state("e26", "n.c", 26), ema_state("sig", "({e12} - {e26})", 9, "CASE WHEN n.i >= 26 THEN {e12} - {e26} END"),
        ema_state("m1", "n.hl", 9), ema_state("m2", "{m1}", 9), ema_state("r14", "n.hl", 14), ema_state("k20", "n.c", 20), ema_state("t20", "n.tr", 20), ("z", "CASE WHEN n.i = 6 THEN n.c END", f"CASE WHEN n.zx IS NULL THEN p.z ELSE {1 - 2 / 15!r} * p.z + {2 / 15!r} * n.zx END"), ema_state("h13", "n.hx", 13), ema_state("a3", "n.ad", 3), ema_state("a10", "n.ad", 10),
        *[(s, x, f"{1 - 2 / 21!r} * p.{s} + {x}") for s, x in (("w", "1.0"), ("sx", "n.c"), ("sy", "n.o"), ("sh", "n.h"), ("sxy", "n.c * n.o"), ("sxh", "n.c * n.h"), ("sxx", "n.c * n.c"), ("shh", "n.h * n.h"))],
    ]) + ", q AS (SELECT *, CASE WHEN i >= 26 THEN e12 - e26 END line, CASE WHEN i >= 17 AND m2 > 0 THEN m1 / m2 END ratio FROM r)",
    "q", recursive=True,
)


def _wilder(s: str, x: str, n: int) -> tuple[str, str, str]:
    return s, f"n.{s}_seed", f"CASE WHEN n.{x} IS NULL THEN p.{s} ELSE {1 - 1 / n!r} * p.{s} + n.{x} / {n}.0 END"


def _wilder_seed(s: str, x: str, n: int) -> str:
    return f"CASE WHEN {so_far(f'count({x})')} = {n} THEN avg({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END {s}_seed"


def _total(s: str, n: int = 14) -> tuple[str, str, str]:
    return s, f"n.{s}_seed", f"CASE WHEN n.{s}_x IS NULL THEN p.{s} ELSE {1 - 1 / n!r} * p.{s} + n.{s}_x END"


def _total_seed(s: str, n: int = 14) -> str:
    return f"CASE WHEN {so_far(f'count({s}_x)')} = {n - 1} THEN {so_far(f'sum({s}_x)')} END {s}_seed"


_RSI = div("100 * up", "up + dn")
proved(
    "wilder_averages", "orders",
    [("wilders", "wilders", ("c",), {}), ("rsi", "rsi", ("c",), {}), ("stochrsi", "stochrsi", ("c",), {}), ("atr", "atr", (), {}), ("natr", "natr", (), {}), ("dm", "dm", (), {}), ("di", "di", (), {}), ("dx", "dx", (), {}), ("adx", "adx", (), {}), ("adxr", "adxr", (), {}), ("chande_kroll_stop", "ck", (), {})],
    [("wilders", 2, "wc"), ("rsi", 4, "rsi"), ("stochrsi", 4, f"CASE WHEN {over(14, 'max(rsi)', 'rsi')} = {over(14, 'min(rsi)', 'rsi')} THEN 0 ELSE (rsi - {over(14, 'min(rsi)', 'rsi')}) / ({over(14, 'max(rsi)', 'rsi')} - {over(14, 'min(rsi)', 'rsi')}) END"), ("atr", 2, "atr"), ("natr", 4, "100 * atr / c"),
     ("dm_plus_dm", 2, "pm"), ("dm_minus_dm", 2, "mm"), ("di_plus_di", 4, "100 * pm / tt"), ("di_minus_di", 4, "100 * mm / tt"), ("dx", 4, "dx"), ("adx", 4, "adx"), ("adxr", 4, f"0.5 * (adx + {lag('adx', 13)})"),
     ("ck_long_stop", 2, over(20, "min(lo)", "lo")), ("ck_short_stop", 2, over(20, "max(hi)", "hi"))],
    f"{_ROWS}, i1 AS (SELECT *, greatest(c - c1, 0) + 0 * c1 upx, greatest(c1 - c, 0) + 0 * c1 dnx, {_TR} tr, CASE WHEN h1 IS NOT NULL THEN CASE WHEN h - h1 > l1 - l AND h > h1 THEN h - h1 ELSE 0 END END pm_x, CASE WHEN h1 IS NOT NULL THEN CASE WHEN l1 - l > h - h1 AND l1 > l THEN l1 - l ELSE 0 END END mm_x, CASE WHEN h1 IS NOT NULL THEN {_TR} END tt_x, {over(10, 'max(h)')} h10, {over(10, 'min(l)')} l10 FROM i0), "
    f"i2 AS (SELECT *, {_wilder_seed('wc', 'c', 14)}, {_wilder_seed('up', 'upx', 14)}, {_wilder_seed('dn', 'dnx', 14)}, {_wilder_seed('atr', 'tr', 14)}, {_wilder_seed('a10', 'tr', 10)}, {', '.join(map(_total_seed, ('pm', 'mm', 'tt')))} FROM i1), "
    + remembered("r", "i2", ["c", "h10", "l10"], [_wilder("wc", "c", 14), _wilder("up", "upx", 14), _wilder("dn", "dnx", 14), _wilder("atr", "tr", 14), _wilder("a10", "tr", 10), *map(_total, ("pm", "mm", "tt"))])
    + f", d0 AS (SELECT *, {div('100 * abs(pm - mm)', 'pm + mm')} dx, {_RSI} rsi, h10 - 3 * a10 hi, l10 + 3 * a10 lo FROM r), d AS (SELECT *, {_wilder_seed('adx', 'dx', 14)} FROM d0), "
    + remembered("r2", "d", ["c", "wc", "rsi", "atr", "pm", "mm", "tt", "dx", "hi", "lo"], [_wilder("adx", "dx", 14)]),
    "r2", recursive=True,
)

proved(
    "state_machines", "orders",
    [("kama", "kama", ("c",), {}), ("vidya", "vidya", ("c",), {}), ("decay", "decay", ("v",), {}), ("edecay", "edecay", ("v",), {}), ("fisher", "fisher", (), {}), ("psar", "psar", (), {})],
    [("kama", 2, "kama"), ("vidya", 2, "vidya"), ("decay", 5, "decay"), ("edecay", 5, "edecay"), ("fisher_fisher", 5, "CASE WHEN fx IS NOT NULL THEN f END"), ("fisher_fisher_signal", 5, f"CASE WHEN fx IS NOT NULL THEN coalesce({lag('f')}, 0) END"), ("psar", 4, "sar")],
    f"{_ROWS}, i1 AS (SELECT *, abs(c - c1) d, (h + l) / 2 m, {lag('l', 2)} l2, {lag('h', 2)} h2 FROM i0), "
    f"i2 AS (SELECT *, pow(CASE WHEN {over(14, 'sum(d)', 'd')} = 0 THEN 1 ELSE abs(c - {lag('c', 14)}) / {over(14, 'sum(d)', 'd')} END * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) kk, 0.2 * {div(over(12, 'stddev_pop(c)'), over(26, 'stddev_pop(c)'))} vk, "
    f"0.66 * ((m - {over(14, 'min(m)')}) / CASE WHEN {over(14, 'max(m)')} = {over(14, 'min(m)')} THEN 0.001 ELSE {over(14, 'max(m)')} - {over(14, 'min(m)')} END - 0.5) fx FROM i1), "
    + remembered("r", "i2", ["fx", "h", "l", "h1", "l1", "h2", "l2"], [
        ("kama", "CASE WHEN n.i = 14 THEN n.c END", "CASE WHEN n.kk IS NULL THEN p.kama ELSE (1 - n.kk) * p.kama + n.kk * n.c END"), ("vidya", "CASE WHEN n.i = 25 THEN n.c END", "CASE WHEN n.vk IS NULL THEN p.vidya ELSE (1 - n.vk) * p.vidya + n.vk * n.c END"),
        ("decay", "n.v", "greatest(n.v, p.decay - 1 / 14.0, 0)"), ("edecay", "n.v", "greatest(n.v, p.edecay * (13 / 14.0))"),
        ("vv", "CASE WHEN n.fx IS NOT NULL THEN CASE WHEN n.fx > 0.99 THEN 0.999 WHEN n.fx < -0.99 THEN -0.999 ELSE n.fx END END", "CASE WHEN n.fx + 0.67 * p.vv > 0.99 THEN 0.999 WHEN n.fx + 0.67 * p.vv < -0.99 THEN -0.999 ELSE n.fx + 0.67 * p.vv END"),
        ("f", "0.5 * ln((1 + {vv}) / (1 - {vv}))", "0.5 * ln((1 + {vv}) / (1 - {vv})) + 0.5 * p.f"),
    ])
    + """, ps AS (SELECT asset_id, ts, i, h, l, fx, kama, vidya, decay, edecay, f, NULL::double sar, NULL::double ext, 0.02::double step, true up FROM r WHERE i = 1 UNION ALL
SELECT asset_id, ts, i, h, l, fx, kama, vidya, decay, edecay, f, CASE WHEN flip THEN e2 ELSE s2 END, CASE WHEN flip THEN CASE WHEN up2 THEN l ELSE h END ELSE e2 END, CASE WHEN flip THEN 0.02 ELSE step2 END, up2 <> flip
FROM (SELECT *, CASE WHEN up2 THEN l < s2 ELSE h > s2 END flip FROM (SELECT *, CASE WHEN i = 2 THEN s1 WHEN up2 THEN least(s1, l1, l2) ELSE greatest(s1, h1, h2) END s2, CASE WHEN i > 2 AND far THEN CASE WHEN up2 THEN h ELSE l END ELSE e1 END e2, CASE WHEN i > 2 AND far THEN least(step1 + 0.02, 0.2) ELSE step1 END step2
FROM (SELECT *, CASE WHEN up2 THEN h > e1 ELSE l < e1 END far FROM (SELECT n.*, p.step step1, CASE WHEN n.i = 2 THEN n.h + n.l >= n.h1 + n.l1 ELSE p.up END up2, CASE WHEN n.i = 2 THEN CASE WHEN n.h + n.l >= n.h1 + n.l1 THEN n.l1 ELSE n.h1 END ELSE p.sar + (p.ext - p.sar) * p.step END s1,
CASE WHEN n.i = 2 THEN CASE WHEN n.h + n.l >= n.h1 + n.l1 THEN n.h ELSE n.l END ELSE p.ext END e1 FROM ps p JOIN r n ON n.asset_id = p.asset_id AND n.i = p.i + 1)))))""",
    "ps", recursive=True,
)


# --- calendar and sessions -----------------------------------------------------------------------
_HOLIDAYS = ("1995-07-04", "1996-12-25", "1997-01-01", "1998-06-10")
_UNITS = {"days": "day", "weeks": "week", "months": "month", "quarters": "quarter", "years": "year"}
proved(
    "calendar_effects", "orders",
    [("timestamp_scalar", "then", (), {"value": "1996-03-13 00:00:00"})] + [("datetime_diff", k, (TS, "then"), {"unit": k}) for k in _UNITS] + [("column_datetime_extract", f"at_{k}", (TS,), {"component": k}) for k in ("year", "month", "quarter", "day", "is_leap_year")]
    + [("month_of_year", "march", (), {"month": "March"}), ("quarter", "q3", (), {"quarter": "Q3"}), ("turn_of_month", "turn", (), {"days_before": 2, "days_after": 3}), ("holiday", "holiday", (), {"days_before": 2, "days_after": 1, "dates": _HOLIDAYS})],
    [(k, None, f"date_diff('{u}', ts, TIMESTAMP '1996-03-13')" if k != "weeks" else "(DATE '1996-03-11' - date_trunc('week', ts)::date) // 7") for k, u in _UNITS.items()] + [(f"at_{k}", None, f"{k}(ts)") for k in ("year", "month", "quarter", "day")] + [("at_is_leap_year", None, "dayofyear(make_date(year(ts), 12, 31)) = 366")]
    + [("march", None, "month(ts) = 3"), ("q3", None, "quarter(ts) = 3"), ("turn", None, "row_number() OVER (PARTITION BY asset_id, date_trunc('month', ts) ORDER BY ts) <= 3 OR row_number() OVER (PARTITION BY asset_id, date_trunc('month', ts) ORDER BY ts DESC) <= 2"),
       ("holiday", None, " OR ".join(f"(ts::date - DATE '{d}' BETWEEN -2 AND 1 AND ts::date <> DATE '{d}')" for d in _HOLIDAYS))],
)

_SESSION = {"London": ("Europe/London", 480, 1020), "Tokyo": ("Asia/Tokyo", 540, 1080), "AsianKillZone": ("America/New_York", 1140, 1380)}


def _minute(zone: str) -> str:
    local = f"timezone('{zone}', ts AT TIME ZONE 'UTC')"
    return f"(hour({local}) * 60 + minute({local}))"


def _session_columns(k: str) -> list[tuple]:
    run = f"(PARTITION BY asset_id, {k}_run, {k} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return [(f"{k}_active", None, k), (f"{k}_opened", None, f"{k} AND NOT {k}1"), (f"{k}_closed", None, f"NOT {k} AND {k}1"), (f"{k}_high", 4, f"CASE WHEN {k} THEN max(h) OVER {run} ELSE 0 END"), (f"{k}_low", 4, f"CASE WHEN {k} THEN min(l) OVER {run} ELSE 0 END")]


proved(
    "trading_sessions", "events",
    [("sessions", k, (), {"session_type": k}) for k in _SESSION] + [("session_time_window", "after_open", (), {"session_type": "London", "minute_offset": 60}), ("session_time_window", "before_close", (), {"session_type": "Tokyo", "minute_offset": 60, "boundary_type": "end"})],
    [x for k in _SESSION for x in _session_columns(k)] + [("after_open", None, f"{_minute('Europe/London')} = 540"), ("before_close", None, f"{_minute('Asia/Tokyo')} = 1020")],
    "a AS (SELECT *, " + ", ".join(f"{_minute(z)} BETWEEN {a} AND {b} {k}" for k, (z, a, b) in _SESSION.items()) + " FROM bars), b AS (SELECT *, " + ", ".join(f"coalesce({lag(k)}, false) {k}1" for k in _SESSION)
    + " FROM a), d AS (SELECT *, " + ", ".join(so_far(f"sum(({k} AND NOT {k}1)::int)") + f" {k}_run" for k in _SESSION) + " FROM b)", "d",
)

_DAY = "(PARTITION BY asset_id, ts::date ORDER BY ts ROWS UNBOUNDED PRECEDING)"
proved(
    "session_gaps", "events", [("session_gap", "g", (), {})],
    [("g_gap_size", 4, "CASE WHEN real AND start THEN (op - psc) / psc * 100 END"), ("g_gap_retrace", 4, "CASE WHEN real AND back IS NOT NULL THEN greatest(back, 0) END"), ("g_gap_filled", None, "CASE WHEN real THEN greatest(back, 0) * 100 >= 100 END"), ("g_psc", 4, "CASE WHEN real THEN psc END"), ("g_psc_timestamp", None, "CASE WHEN real THEN strftime(pts, '%Y-%m-%d %H:%M:%S') END")],
    f"a AS (SELECT *, {lag('c')} c1, {lag('ts')} t1, {lag('ts')}::date <> ts::date start FROM bars), b AS (SELECT *, first_value(o) OVER {_DAY} op, first_value(c1) OVER {_DAY} psc, first_value(t1) OVER {_DAY} pts, coalesce(first_value(start) OVER {_DAY}, false) real, min(l) OVER {_DAY} lo, max(h) OVER {_DAY} hi FROM a), "
    "d AS (SELECT *, CASE WHEN op > psc THEN (op - lo) / (op - psc) WHEN op < psc THEN (hi - op) / (psc - op) END back FROM b)", "d",
)

# --- across assets ----------------------------------------------------------------------------------
_PLACE = lambda way: f"row_number() OVER (PARTITION BY ts ORDER BY c {way}, asset_id)"
_ALL = "count(c) OVER (PARTITION BY ts)"
proved(
    "cross_sections", "events",
    [("bottom_k", "low2", ("c",), {"k": 2}), ("bottom_k_percent", "low_pct", ("c",), {"k": 40}), ("top_k_percent", "top_pct", ("c",), {"k": 40}), ("cs_winsorize", "wins", ("c",), {"lower_limit": 0.2, "upper_limit": 0.8}), ("cs_rank", "down", ("c",), {"ascending": False}), ("roc", "r0", ("v",), {"period": 1}), ("div", "r", ("r0", 100.0), {}), ("cs_momentum", "momentum", ("r",), {})],
    [("low2", None, f"{_PLACE('ASC')} <= 2"), ("low_pct", None, f"{_PLACE('ASC')} <= ceil(40 * {_ALL} / 100.0)"), ("top_pct", None, f"{_PLACE('DESC')} <= ceil(40 * {_ALL} / 100.0)"),
     ("wins", 4, "least(greatest(c, quantile_cont(c, 0.2) OVER (PARTITION BY ts)), quantile_cont(c, 0.8) OVER (PARTITION BY ts))"), ("down", 1, f"{_PLACE('DESC')}::double"), ("momentum", 5, so_far("product(1 + m)"))],
    f"a AS (SELECT *, (v / {lag('v')} - 1) / 100 r FROM bars), b AS (SELECT *, avg(r) OVER (PARTITION BY ts) m FROM a)", "b",
)


# --- groups and reports --------------------------------------------------------------------------------
def _order_bars(spark, sf_dir):
    return feeds.order_bars(spark, sf_dir).withColumn("k", F.month(TS)).withColumn("up", F.col("c") > F.col("o"))


def _text_ts(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query(f"""WITH {_ORDER_BARS}, k AS (SELECT *, month(ts) k, c > o up FROM bars) SELECT asset_id, k group_key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') ts, min(v) = max(v) same_v, count(DISTINCT v) = count(v) unique_v, bool_or(up) any_up, NOT bool_or(up) none_up,
round(avg(c), 2) mean, count(c) n, round(min(c), 2) lo, round(max(c), 2) hi, round(arg_min(c, ts), 2) first FROM k GROUP BY 1, 2""")
def grouped_more(spark, sf_dir):
    b, at = _order_bars(spark, sf_dir), [KEY, "group_key"]
    out = grouped.groupby_any_agg(b, "k", "v", "IsEqual").withColumnRenamed("value", "same_v")
    more = [(grouped.groupby_any_agg, "v", "IsUnique", "unique_v"), (grouped.groupby_boolean_agg, "up", "AnyOf", "any_up"), (grouped.groupby_boolean_agg, "up", "NoneOf", "none_up")]
    more += [(grouped.groupby_numeric_agg, "c", agg, name) for agg, name in (("mean", "mean"), ("count", "n"), ("min", "lo"), ("max", "hi"), ("first", "first"))]
    for f, x, agg, name in more:
        out = out.join(f(b, "k", x, agg).select(*at, F.col("value").alias(name)), at)
    return _text_ts(out.select(KEY, "group_key", TS, "same_v", "unique_v", "any_up", "none_up", *[F.round(c, 2).alias(c) for c in ("mean",)], "n", *[F.round(c, 2).alias(c) for c in ("lo", "hi", "first")]), TS)


@query(f"""WITH {_ORDER_BARS}, k AS (SELECT *, isodow(ts) - 1 k FROM bars), s AS (SELECT asset_id, k, sum(v) "value", min(ts) t FROM k GROUP BY 1, 2)
SELECT asset_id, k "label", "value", row_number() OVER (PARTITION BY asset_id ORDER BY t, k) "position" FROM s""")
def report_bars(spark, sf_dir):
    """bar_chart_report and its cross-asset form: one bar for each label."""
    return reports.bar_chart(feeds.order_bars(spark, sf_dir).withColumn("d", F.weekday(TS)), "d", "v")


@query(f"""WITH {_ORDER_BARS}, a AS (SELECT asset_id, 'inner' ring, isodow(ts) - 1 lab, sum(v) s FROM bars GROUP BY ALL UNION ALL SELECT asset_id, 'outer', month(ts), sum(v) FROM bars GROUP BY ALL)
SELECT asset_id, ring, lab "label", round(100 * s / sum(s) OVER (PARTITION BY asset_id, ring), 4) "percent" FROM a""")
def report_nested_pie(spark, sf_dir):
    b = feeds.order_bars(spark, sf_dir).withColumn("d", F.weekday(TS)).withColumn("m", F.month(TS))
    return reports.nested_pie_chart(b, "d", "m", "v").select(KEY, "ring", "label", F.round("percent", 4).alias("percent"))


@query(f"""WITH {_ORDER_BARS}, i AS (SELECT *, row_number() OVER ({_W}) - 1 i, c > o up FROM bars) SELECT asset_id, coalesce(min(i) FILTER (v = 3), -1) first_three, coalesce(min(i) FILTER (v = -5), -1) never, bool_and(up) all_up, bool_or(up) any_up, count(*) n,
count(DISTINCT v) kinds, arg_max(v, ts)::varchar last_v, round(skewness_pop, 3) skew FROM (SELECT *, (avg(pow(c - mu, 3)) OVER (PARTITION BY asset_id)) / pow(avg(pow(c - mu, 2)) OVER (PARTITION BY asset_id), 1.5) skewness_pop FROM (SELECT *, avg(c) OVER (PARTITION BY asset_id) mu FROM i)) GROUP BY asset_id, skewness_pop""")
def report_more_cards(spark, sf_dir):
    b = _order_bars(spark, sf_dir)
    out = reports.index_card(b, "v", 3.0).select(KEY, F.col("value").cast("long").alias("first_three"))
    parts = [(reports.index_card(b, "v", -5.0).withColumn("value", F.col("value").cast("long")), "never"), (reports.cards(b, "up", "all"), "all_up"), (reports.cards(b, "up", "any"), "any_up"), (reports.cards(b, "v", "count_all"), "n"), (reports.cards(b, "v", "count_distinct"), "kinds"), (reports.cs_table(b, "v"), "last_v"), (reports.cards(b, "c", "skew"), "skew")]
    for part, name in parts:
        out = out.join(part.select(KEY, F.col("value").alias(name)), KEY)
    return out.withColumn("skew", F.round("skew", 3))


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, {_T}, round(c, 2) "Close", v "Volume" FROM bars WHERE v > 3 AND c > o""")
def report_table(spark, sf_dir):
    b = _order_bars(spark, sf_dir).withColumn("pick", F.expr("v > 3 and up"))
    return _text_ts(reports.table_report(b, "pick", {"c": "Close", "v": "Volume"}).withColumn("Close", F.round("Close", 2)), TS)


@query(f"""WITH {_ORDER_BARS} SELECT asset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') "pivot", round(h, 2) h, round(l, 2) l FROM bars WHERE v > 3""")
def event_markers(spark, sf_dir):
    return _text_ts(reports.event_marker(_order_bars(spark, sf_dir).withColumn("pick", F.col("v") > 3), "pick", ["h", "l"]), "pivot")


@query("""SELECT p_partkey, replace(p_name, 'a', '_') re, replace(p_type, 'STEEL', 'IRON') ty FROM part""")
def string_replacement(spark, sf_dir):
    out = _chain(feeds.read(spark, sf_dir, "part"), ("string_replace", "re", ("p_name",), {"pattern": "a", "replacement": "_"}), ("string_replace", "ty", ("p_type",), {"pattern": "STEEL", "replacement": "IRON"}))
    return out.select("p_partkey", "re", "ty")


@query("""WITH bars AS (SELECT o_orderpriority asset_id, date_trunc('day', o_orderdate) ts, sum(o_totalprice * o_totalprice) / sum(o_totalprice) vw, count(*)::double n FROM orders GROUP BY 1, 2) SELECT asset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, round(vw, 2) vwap, n trades FROM bars""")
def vwap_and_trades(spark, sf_dir):
    b = feeds.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias(KEY), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias(TS)).agg((F.sum(F.col("o_totalprice") * F.col("o_totalprice")) / F.sum("o_totalprice")).alias("vw"), F.count("*").cast("double").alias("n"))
    return _text_ts(_chain(b, ("vwap", "vwap", (), {}), ("trade_count", "trades", (), {})).select(KEY, TS, F.round("vwap", 2).alias("vwap"), "trades"), TS)


# --- feeds and reference instruments ---------------------------------------------------------------------
_MADE = {"string": ("concat({a}, '-{j}')", "concat({a}, '-{j}')"), "double": ("cast(floor({c}) * {j} as double)", "floor({c}) * {j}"), "int": ("cast({v} * {j} as int)", "cast({v} * {j} as int)"), "long": ("cast({v} * {j} as bigint)", "cast({v} * {j} as bigint)"), "timestamp": ("cast(date_add(cast({t} as date), {j}) as timestamp)", "({t} + INTERVAL {j} DAY)")}
_FACT = dict(a="asset_id", c="c", v="v", t="ts")


def _feed_query(name: str) -> None:
    """A feed of facts that Spark derives from the orders' bars, on their days."""
    feed = feeds.FEEDS[name]
    columns = {c: (kind, j) for j, (c, kind) in enumerate(feed.columns.items(), 1)}
    option = next(iter(feed.options.items()), None)
    pick = f"CASE WHEN v > 2 THEN '{option[1][0]}' ELSE '{option[1][-1]}' END" if option else "''"

    def cell(c: str, kind: str, j: int) -> str:
        made = pick if option and c == option[0] else _MADE[kind][1].format(j=j, **_FACT)
        return f"strftime({made}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp" else made

    where = f"v > 1 AND {pick} = '{option[1][0]}'" if option else "v > 1"
    shown = ", ".join(f'CASE WHEN {where} THEN {cell(c, kind, j)} END AS "{c}"' for c, (kind, j) in columns.items())

    def run(spark, sf_dir):
        bars = feeds.order_bars(spark, sf_dir)
        facts = bars.where("v > 1").select(KEY, TS, *[F.expr((pick if option and c == option[0] else _MADE[kind][0].format(j=j, **_FACT))).cast(kind).alias(c) for c, (kind, j) in columns.items()])
        out = feeds.with_feed_id(bars, facts, name, **({option[0]: option[1][0]} if option else {}))
        prefix = feeds.prefix_of(name)
        return _text_ts(out.select(KEY, TS, *[F.col(f"`{prefix}{c}`").alias(c) for c in columns]), TS, *[c for c, (kind, _) in columns.items() if kind == "timestamp"])

    run.__name__ = f"feed_{name}"
    query(f"WITH {_ORDER_BARS} SELECT asset_id, {_T}, {shown} FROM bars")(run)


for _name in feeds.FEEDS:
    _feed_query(_name)


@query(f"""WITH {_EVENT_BARS}, f AS (SELECT ts, c * 2 val, v::bigint rev FROM bars WHERE asset_id = (SELECT min(asset_id) FROM bars) AND v > 1) SELECT asset_id, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') ts, round(val, 3) "value", rev "revision" FROM bars LEFT JOIN f ON f.ts = bars.ts""")
def feed_economic_indicator(spark, sf_dir):
    """A macro series by category, the same for every asset."""
    bars = feeds.event_bars(spark, sf_dir)
    first = bars.agg(F.min(KEY).alias("first"))
    facts = bars.join(F.broadcast(first), F.col(KEY) == F.col("first")).where("v > 1").select(F.lit("CPI").alias("category"), TS, F.col(TS).alias("observation_date"), (F.col("c") * 2).alias("value"), F.col("v").cast("long").alias("revision"))
    out = feeds.economic_indicator(bars, facts, "CPI")
    return _text_ts(out.select(KEY, TS, F.round("`ECON:CPI:value`", 3).alias("value"), F.col("`ECON:CPI:revision`").alias("revision")), TS)


def _reference_query(name: str) -> None:
    prefix = feeds.REFERENCES[name]
    ticker = "3-MEDIUM"

    def run(spark, sf_dir):
        b = feeds.order_bars(spark, sf_dir)
        out = feeds.with_reference_id(b, b, name, ticker)
        return _text_ts(out.select(KEY, TS, *[F.round(F.col(f"`{prefix}:{ticker}:{c}`"), 2).alias(f"ref_{c}") for c in "cohl"]), TS)

    run.__name__ = f"reference_{name}"
    query(f"WITH {_ORDER_BARS}, r AS (SELECT ts, c rc, o ro, h rh, l rl FROM bars WHERE asset_id = '{ticker}') SELECT asset_id, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') ts, round(rc, 2) ref_c, round(ro, 2) ref_o, round(rh, 2) ref_h, round(rl, 2) ref_l FROM bars LEFT JOIN r ON r.ts = bars.ts")(run)


for _name in feeds.REFERENCES:
    _reference_query(_name)


# --- structure and the rest of what has memory -------------------------------------------------------------
proved(
    "gaps_and_crossings", "orders",
    [("fair_value_gap", "g", (), {}), ("crossover", "over", ("c", "o"), {}), ("crossunder", "under", ("c", "o"), {}), ("alias_number", "alias_number", ("c",), {}), ("static_cast_to_timestamp", "at", (TS,), {})],
    [("g_fvg", None, "kind"), ("g_top", 2, "top"), ("g_bottom", 2, "bottom"), ("g_mitigated_index", None, "CASE WHEN kind IS NOT NULL THEN coalesce(j, 0) END"), ("over", None, "CASE WHEN c1 IS NOT NULL THEN c > o AND c1 <= o1 END"), ("under", None, "CASE WHEN c1 IS NOT NULL THEN c < o AND c1 >= o1 END"),
     ("alias_number", 2, "c"), ("at", None, "strftime(ts, '%Y-%m-%d %H:%M:%S')")],
    f"a AS (SELECT *, row_number() OVER ({_W}) - 1 i, {lag('c')} c1, {lag('o')} o1, {lag('h')} h1, {lag('l')} l1, lead(h) OVER ({_W}) h2, lead(l) OVER ({_W}) l2 FROM bars), "
    "b AS (SELECT *, CASE WHEN h1 < l2 AND c > o THEN 1 WHEN l1 > h2 AND c < o THEN -1 END::bigint kind FROM a), d AS (SELECT *, CASE kind WHEN 1 THEN l2 WHEN -1 THEN l1 END top, CASE kind WHEN 1 THEN h1 WHEN -1 THEN h2 END bottom FROM b), "
    "e AS (SELECT d.asset_id, d.i, min(x.i) j FROM d JOIN d x ON x.asset_id = d.asset_id AND x.i >= d.i + 2 AND CASE d.kind WHEN 1 THEN x.l <= d.top WHEN -1 THEN x.h >= d.bottom END GROUP BY 1, 2), f AS (SELECT d.*, e.j FROM d LEFT JOIN e USING (asset_id, i))", "f",
)

_RUN = "(PARTITION BY asset_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_HELD = lambda s, x, n: (s, f"n.{x}", f"CASE WHEN n.{x} IS NULL THEN p.{s} ELSE {1 - 2 / (n + 1)!r} * p.{s} + {2 / (n + 1)!r} * n.{x} END")
proved(
    "volume_and_strength", "orders",
    [("kvo", "kvo0", (), {}), ("div", "kvo", ("kvo0", 100.0), {}), ("qqe", "qqe", (), {})],
    [("kvo", 3, "(a - b) / 100"), ("qqe_result", 3, "ma - 50"), ("qqe_rsi_ma", 3, "ma"), ("qqe_long_line", 3, "low"), ("qqe_short_line", 3, "high")],
    f"{_ROWS}, i1 AS (SELECT *, h + l + c hlc, greatest(c - c1, 0) + 0 * c1 upx, greatest(c1 - c, 0) + 0 * c1 dnx FROM i0), i2 AS (SELECT *, CASE WHEN hlc > {lag('hlc')} THEN 1 WHEN hlc < {lag('hlc')} THEN -1 END t0, {_wilder_seed('up', 'upx', 14)}, {_wilder_seed('dn', 'dnx', 14)} FROM i1), "
    f"i3 AS (SELECT *, last_value(t0 IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) t FROM i2), i4 AS (SELECT *, coalesce(t <> {lag('t')}, true)::int turned, {lag('hl')} hl1 FROM i3), i5 AS (SELECT *, {so_far('sum(turned)')} run FROM i4), "
    f"i6 AS (SELECT *, sum(hl) OVER {_RUN} + coalesce(first_value(hl1) OVER {_RUN}, 0) cm FROM i5), i7 AS (SELECT *, CASE WHEN t IS NOT NULL THEN v * t * 100 * abs(2 * {div('hl', 'cm')} - 1) END force FROM i6), "
    + remembered("r", "i7", ["c"], [_HELD("a", "force", 14), _HELD("b", "force", 28), _wilder("up", "upx", 14), _wilder("dn", "dnx", 14), ("ma", "100 * {up} / nullif({up} + {dn}, 0)", f"{1 - 2 / 6!r} * p.ma + {2 / 6!r} * (100 * {{up}} / nullif({{up}} + {{dn}}, 0))")])
    + f", q AS (SELECT *, {lag('ma')} ma1, abs(ma - {lag('ma')}) change FROM r), "
    + remembered("r2", "q", ["a", "b", "ma"], [
        _HELD("one", "change", 27), ("two", "{one}", f"{1 - 2 / 28!r} * p.two + {2 / 28!r} * {{one}}"),
        ("low", "n.ma - 4.236 * {two}", "CASE WHEN n.ma1 > p.low AND n.ma > p.low THEN greatest(p.low, n.ma - 4.236 * {two}) ELSE n.ma - 4.236 * {two} END"),
        ("high", "n.ma + 4.236 * {two}", "CASE WHEN n.ma1 < p.high AND n.ma < p.high THEN least(p.high, n.ma + 4.236 * {two}) ELSE n.ma + 4.236 * {two} END"),
    ]), "r2", recursive=True,
)

_LAST = lambda x: f"coalesce(last_value({x} IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0)"


def _retraced(spark, sf_dir):
    return _chain(feeds.order_bars(spark, sf_dir), ("swing_highs_lows", "s", (), {}), ("retracements", "r", ("s_high_low", "s_level"), {}))


@query(f"""WITH {_ORDER_BARS}, {_SWINGS}, a AS (SELECT *, {_LAST('hl')} way, {_LAST('CASE WHEN hl = 1 THEN lv END')} top, {_LAST('CASE WHEN hl = -1 THEN lv END')} bot FROM swings), b AS (SELECT *, coalesce(way <> lag(way) OVER ({_W}), true) turned FROM a),
d AS (SELECT *, {so_far('sum(turned::int)')} run, coalesce(CASE WHEN abs(top - bot) > 1e-10 THEN round(100 * CASE WHEN way = 1 AND NOT turned THEN (top - l) / (top - bot) WHEN way = -1 THEN (h - bot) / (top - bot) END, 1) END, 0) now FROM b),
e AS (SELECT *, greatest(max(now) OVER {_RUN}, 0) deep FROM d), f AS (SELECT *, coalesce({lag('way')}, 0) w, coalesce({lag('now')}, 0) n1, coalesce({lag('deep')}, 0) d1 FROM e), g AS (SELECT *, coalesce(w <> {lag('w')}, false) ch FROM f), x AS (SELECT *, {so_far('sum(ch::int)')} chs FROM g)
SELECT asset_id, {_T}, CASE WHEN chs > 3 OR (chs = 3 AND NOT ch) THEN w ELSE 0 END direction, CASE WHEN chs > 3 OR (chs = 3 AND NOT ch) THEN n1 ELSE 0 END "current", CASE WHEN chs > 3 OR (chs = 3 AND NOT ch) THEN d1 ELSE 0 END deepest FROM x""")
def swing_retracements(spark, sf_dir):
    return _text_ts(_retraced(spark, sf_dir).select(KEY, TS, F.col("r_direction").alias("direction"), F.col("r_current_retracement").alias("current"), F.col("r_deepest_retracement").alias("deepest")), TS)


_LEG = "ASOF LEFT JOIN bars {0} ON {0}.asset_id = d.asset_id AND {0}.contract = d.{1} AND {0}.ts >= d.ts"


@query(f"""WITH RECURSIVE q AS (SELECT *, date_trunc('day', l_shipdate) ts, (date_trunc('quarter', l_shipdate) + to_months(3 * (l_linenumber - 1)))::date due FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL),
bars AS (SELECT l_returnflag asset_id, ts, strftime(due, '%Y-%m') contract, (due + to_months(3))::date - 1 expiry, avg(l_extendedprice) o, max(l_extendedprice) h, min(l_extendedprice) l, avg(l_extendedprice) c, sum(l_quantity) v, count(*)::double oi FROM q WHERE ts::date <= (due + to_months(3))::date - 1 GROUP BY 1, 2, 3, 4),
spans AS (SELECT asset_id, contract, expiry, min(ts) first, max(ts) last FROM bars GROUP BY 1, 2, 3),
roots AS (SELECT asset_id, count(*) n, list(contract ORDER BY expiry) contracts, list(first ORDER BY expiry) firsts, list(last ORDER BY expiry) lasts, list(expiry ORDER BY expiry) expiries FROM spans GROUP BY 1),
days AS (SELECT asset_id, ts, row_number() OVER ({_W}) d FROM (SELECT DISTINCT asset_id, ts FROM bars)),
rolls AS (SELECT asset_id, NULL::timestamp ts, 0::bigint d, 1::bigint pos, false traded FROM roots UNION ALL
SELECT asset_id, ts, d, CASE WHEN ts >= firsts[pos1] AND pos1 < n AND expiries[pos1] <= ts::date + 5 THEN pos1 + 1 ELSE pos1 END, ts >= firsts[pos1]
FROM (SELECT days.asset_id, days.ts, days.d, n, firsts, expiries, coalesce(pos - 1 + nullif(list_position(list_transform(lasts[pos:], lambda x: x >= days.ts), true), 0), n) pos1 FROM rolls p JOIN days ON days.asset_id = p.asset_id AND days.d = p.d + 1 JOIN roots ON roots.asset_id = p.asset_id)),
d AS (SELECT asset_id, ts, contracts[pos] front, CASE WHEN ts >= firsts[least(pos + 1, n)] THEN contracts[least(pos + 1, n)] ELSE contracts[pos] END back FROM rolls JOIN roots USING (asset_id) WHERE traded),
legs AS (SELECT d.asset_id, d.ts, front, f.o, f.h, f.l, f.c, f.v, f.oi, {', '.join(f'b.{x} / f.{x} r{x}' for x in 'ohlc')} FROM d {_LEG.format('f', 'front')} {_LEG.format('b', 'back')} WHERE f.ts IS NOT NULL AND b.ts IS NOT NULL),
s AS (SELECT *, coalesce(front <> {lag('front')}, false) rolled FROM legs)
SELECT asset_id, {_T}, front contract, {', '.join(f"round(ln({x} * coalesce(product(r{x}) FILTER (rolled) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)), 6) ln_{x}" for x in 'ohlc')}, v, oi FROM s""")
def futures_continuation(spark, sf_dir):
    """Return flags as roots; the nth line of an order is for delivery n - 1 quarters ahead, so
    that several contracts trade on a day, each until its quarter's end. Prices as logarithms,
    as ratios multiply over many rolls."""
    quarter = F.to_date(F.add_months(F.date_trunc("quarter", "l_shipdate"), 3 * (F.col("l_linenumber") - 1)))
    lines = feeds.read(spark, sf_dir, "lineitem").where("l_returnflag is not null and l_extendedprice is not null").select(
        F.col("l_returnflag").alias(KEY), F.date_trunc("day", "l_shipdate").alias(TS), F.date_format(quarter, "yyyy-MM").alias("contract"), F.last_day(F.add_months(quarter, 2)).alias("expiry"), "l_extendedprice", "l_quantity"
    )
    price = F.col("l_extendedprice")
    bars = lines.where(F.to_date(TS) <= F.col("expiry")).groupBy(KEY, TS, "contract", "expiry").agg(
        F.avg(price).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.avg(price).alias("c"), F.sum(F.col("l_quantity").cast("double")).alias("v"), F.count("*").cast("double").alias("oi")
    )
    out = futures.continuous(bars, "last_trading_day", 5, "backward", "ratio")
    return _text_ts(out, TS).select(KEY, TS, "contract", *[F.round(F.ln(x), 6).alias(f"ln_{x}") for x in futures.PRICES], "v", "oi")
