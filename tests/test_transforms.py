"""Transforms on small vectors and against plain loops."""

import datetime as dt
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import functions, operators  # noqa: F401
from tidemark.core import REGISTRY, apply, chain, on_valid
from tidemark.operators import cross_section, futures, grouped, reports, resample
from tidemark.sources import feeds

SF = "/root/testdata/sf0.001"


def bars(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("A", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "asset_id string, ts timestamp, " + ", ".join(f"{c} double" for c in columns))


def values(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def near(got, expected, tol=1e-6):
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=tol, abs_tol=tol)), (got, expected)


def test_rolling_volatility(spark):
    b = bars(spark, c=[100, 101, 103, 102, 105, 110])
    near(values(apply(b, "return_vol", "x", period=3), "x"), [None, None, None, 0.015030, 0.020386, 0.029293], 1e-4)
    near(values(apply(b, "price_diff_vol", "x", period=3), "x"), [None, None, None, 1.527525, 2.081666, 3.055050], 1e-6)


def test_crossings(spark):
    b = bars(spark, x=[81.59, 81.06, 82.87, 83.00], y=[81.85, 81.20, 81.55, 82.91])
    assert values(apply(b, "crossover", "r", "x", "y"), "r") == [None, False, True, False]
    assert values(apply(b, "crossany", "r", "x", "y"), "r") == [None, False, True, False]
    assert values(apply(b, "crossunder", "r", "x", "y"), "r") == [None, False, False, False]


def test_sma_and_null_compression(spark):
    near(values(apply(bars(spark, c=[2, 4, 6, 8, 10]), "sma", "m", "c", period=4), "m"), [None, None, None, 5, 7])
    near(values(apply(bars(spark, c=[2, 4, 6]), "sma", "m", "c", period=4), "m"), [None] * 3)
    near(values(on_valid(bars(spark, c=[2, None, 4, 6, None, 8]), "sma", "m", "c", period=2), "m"), [None, None, 3, 5, None, 7])


def test_grouped(spark):
    b = bars(spark, c=[10, 20, 30, 40, 50, 60]).withColumn("k", F.when(F.dayofmonth("ts") % 2 == 1, "A").otherwise("B"))
    day = lambda r: (r.group_key, r.ts.day, r.value)
    assert sorted(map(day, grouped.groupby_numeric_agg(b, "k", "c").collect())) == [("A", 5, 90.0), ("B", 6, 120.0)]
    assert sorted(map(day, grouped.groupby_numeric_agg(b, "k", "c", "first").collect())) == [("A", 1, 10.0), ("B", 2, 20.0)]
    assert [r.value for r in grouped.groupby_any_agg(b, "k", "c", "IsUnique").collect()] == [True, True]


def test_cross_section(spark):
    rows = [[10, 50, 80, 15, 45], [30, 40, 90, 25, 55], [20, 60, 70, 35, 65]]
    data = [(f"Asset{j + 1}", dt.datetime(2020, 1, i + 1), float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)]
    b = spark.createDataFrame(data, "asset_id string, ts timestamp, c double")
    got = apply(b, "top_k", "t", "c", k=2).where("t").collect()
    assert {(r.ts.day, r.asset_id[-1]) for r in got} == {(1, "3"), (1, "2"), (2, "3"), (2, "5"), (3, "3"), (3, "5")}
    assert cross_section.complete(b.where("not (asset_id = 'Asset1' and c = 30)"), "c").select("ts").distinct().count() == 2
    prices = {"aapl": [100, 102, 101, 105], "msft": [200, 198, 202, 205], "tsla": [300, 303, 299, 310]}
    data = [(a, dt.datetime(2020, 1, i + 1), float(x[i]) / x[i - 1] - 1) for a, x in prices.items() for i in range(1, 4)]
    out = apply(spark.createDataFrame(data, "asset_id string, ts timestamp, r double"), "cs_momentum", "m", "r")
    near([r.m for r in out.where("asset_id = 'aapl'").orderBy("ts").collect()], [1.006667, 1.005726, 1.036315], 1e-5)


def test_resample_is_right_closed(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 10, i), 100.0 + i, 105.0 + i, 95.0 + i, 102.0 + i, 1000.0 + 100 * i, 100.0 + i, 10 + i, "val%d" % i) for i in range(10)]
    b = spark.createDataFrame(rows, "asset_id string, ts timestamp, o double, h double, l double, c double, v double, vw double, n long, s string")
    got = resample.resample(b, "5Min").orderBy("ts").collect()
    assert [r.ts.minute for r in got] == [0, 5, 10]
    r = got[1]
    assert (r.o, r.h, r.l, r.c, r.v, r.vw, r.n, r.s) == (101, 110, 96, 107, 6500, 103, 65, "val5")


def loop_wilders(x, n):
    out, y = [], None
    for i, v in enumerate(x):
        y = None if i < n - 1 else sum(x[:n]) / n if i == n - 1 else y + (v - y) / n
        out.append(y)
    return out


def test_recurrences_against_loops(spark):
    c = [100 + 7 * math.sin(i) + i % 5 for i in range(60)]
    h, low = [x + 1 + i % 3 for i, x in enumerate(c)], [x - 2 - i % 2 for i, x in enumerate(c)]
    b = bars(spark, o=c, h=h, l=low, c=c, v=[10] * 60)
    y, ema = None, []
    for x in c:
        y = x if y is None else y + (x - y) * 2 / 11
        ema.append(y)
    near(values(apply(b, "ema", "e", "c", period=10), "e"), ema)
    up, down = [max(b_ - a, 0) for a, b_ in zip(c, c[1:])], [max(a - b_, 0) for a, b_ in zip(c, c[1:])]
    rsi = [None] + [None if u is None else 100 * u / (u + d) for u, d in zip(loop_wilders(up, 14), loop_wilders(down, 14))]
    near(values(apply(b, "rsi", "r", "c", period=14), "r"), rsi)
    tr = [h[i] - low[i] if i == 0 else max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(60)]
    near(values(apply(b, "atr", "a", period=14), "a"), loop_wilders(tr, 14))
    two, y = [], None
    for x in ema:
        y = x if y is None else y + (x - y) * 2 / 11
        two.append(y)
    near(values(apply(b, "dema", "d", "c", period=10), "d"), [None if i < 18 else 2 * a - e for i, (a, e) in enumerate(zip(ema, two))])


def test_strings_and_dates(spark):
    df = spark.createDataFrame([("ab-cd EF",), ("",), (None,)], "s string")
    case = lambda o: [r.r for r in apply(df, "string_case", "r", "s", operation=o).collect()]
    assert case("title")[0] == "Ab-Cd Ef" and case("swapcase")[0] == "AB-CD ef" and case("capitalize")[0] == "Ab-cd ef"
    t = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 3, 1, 1))], "a timestamp, b timestamp")
    diff = lambda u: apply(t, "datetime_diff", "r", "a", "b", unit=u).first().r
    assert [diff(u) for u in ("days", "hours", "months", "quarters", "years")] == [30, 698, 2, 0, 0]


def test_reports(spark):
    b = bars(spark, c=[1, 2, 2, 4])
    assert reports.index_card(b, "c", 2.0).first().value == 1 and reports.index_card(b, "c", 9.0).first().value == -1
    assert reports.quantile_card(b, "c", 0.5, "higher").first().value == 2
    assert sum(r["count"] for r in reports.histogram(b, "c", 3).collect()) == 4
    assert [r.label for r in reports.bar_chart(b, "c", "c").orderBy("position").collect()] == [1, 2, 4]


def loop_retracements(h, low, kinds, levels):
    way, now, deep, top, bottom = [], [], [], 0.0, 0.0
    for i, k in enumerate(kinds):
        was = way[-1] if way else 0
        way.append(k or was)
        top, bottom = (levels[i] if k == 1 else top), (levels[i] if k == -1 else bottom)
        x = 0.0
        if way[i] == -1:
            x = round(100 * (h[i] - bottom) / (top - bottom), 1)
        elif way[i] == was == 1:
            x = round(100 * (top - low[i]) / (top - bottom), 1)
        now.append(x)
        deep.append(max(deep[-1] if was == way[i] and deep else 0.0, x))
    way, now, deep = [0, *way[:-1]], [0.0, *now[:-1]], [0.0, *deep[:-1]]
    changes = [i for i in range(1, len(way)) if way[i] != way[i - 1]]
    start = changes[2] + 1 if len(changes) > 2 else len(way)
    return [[0 if i < start else v for i, v in enumerate(x)] for x in (way, now, deep)]


def loop_liquidity(h, low, kinds, levels, share):
    width, out, used = (max(h) - min(low)) * share, [None] * len(h), set()
    for k in (1, -1):
        for i in range(len(h)):
            if kinds[i] != k or i in used:
                continue
            past = [j for j in range(i + 1, len(h)) if (h[j] >= levels[i] + width if k == 1 else low[j] <= levels[i] - width)]
            end = past[0] if past else 0
            group = [i] + [j for j in range(i + 1, end or len(h)) if kinds[j] == k and j not in used and abs(levels[j] - levels[i]) <= width]
            if len(group) > 1:
                used |= set(group)
                out[i] = (k, sum(levels[j] for j in group) / len(group), group[-1], end)
    return out


def test_structure_against_loops(spark):
    c = [100 + 9 * math.sin(i / 2.3) + 5 * math.cos(i / 7.1) + (i * 7919 % 13) / 9 for i in range(220)]
    h, low = [x + 1 + i % 3 / 7 for i, x in enumerate(c)], [x - 1 - i % 4 / 9 for i, x in enumerate(c)]
    b = apply(bars(spark, o=c, h=h, l=low, c=c, v=[1] * 220), "swing_highs_lows", "s", swing_length=3)
    kinds, levels = values(b, "s_high_low"), values(b, "s_level")
    swings = [k for k in kinds if k]
    assert len(swings) > 20 and all(a == -b_ for a, b_ in zip(swings, swings[1:])) and kinds[0] and kinds[-1]
    r = apply(b, "retracements", "r", "s_high_low", "s_level")
    for name, expected in zip(("direction", "current_retracement", "deepest_retracement"), loop_retracements(h, low, kinds, levels), strict=True):
        near(values(r, f"r_{name}"), expected)
    q = apply(b, "liquidity", "q", "s_high_low", "s_level", range_percent=0.15).orderBy("ts").collect()
    got = [None if x.q_liquidity is None else (x.q_liquidity, round(x.q_level, 9), x.q_end, x.q_swept) for x in q]
    expected = [x and (x[0], round(x[1], 9), x[2], x[3]) for x in loop_liquidity(h, low, kinds, levels, 0.15)]
    assert got == expected and any(expected)


def test_structure_without_swings(spark):
    b = apply(bars(spark, o=[1], h=[2], l=[1], c=[1], v=[1]), "swing_highs_lows", "s")
    row = apply(apply(b, "bos_choch", "b", "s_high_low", "s_level"), "previous_high_low", "p").first()
    assert row.s_high_low is None and row.b_bos == 0 and row.p_previous_high is None and row.p_broken_high is False


def test_registry_is_wide():
    assert len(REGISTRY) >= 300


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts", "value", "event_id")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, feeds.event_bars(spark, SF).select("asset_id", "ts", "o", "h", "l", "c", "v").collect()))


def test_order_blocks(spark):
    """A high at row 2 is passed by the close of row 5: the lowest bar between is row 4; row 7
    falls below it, and row 9 rises above its top and takes it back."""
    h = [10, 11, 15, 12, 11, 17, 18, 14, 9, 20, 21, 19]
    l = [8, 9, 12, 10, 7, 11, 15, 6, 5, 8, 18, 15]  # noqa: E741
    c = [9, 10, 13, 11, 8, 16, 17, 7, 6, 19, 20, 16]
    kinds = [None, None, 1, None, None, None, 1, None, -1, None, 1, None]
    rows = [("A", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(c[i]), float(h[i]), float(l[i]), float(c[i]), float(i + 1), kinds[i]) for i in range(12)]
    b = spark.createDataFrame(rows, "asset_id string, ts timestamp, o double, h double, l double, c double, v double, k int")
    whole = apply(b, "order_blocks", "b", "k")
    names = [f"b_{x}" for x in ("ob", "top", "bottom", "ob_volume", "mitigated_index", "percentage")]
    shown = {i: tuple(r[n] for n in names) for i, r in enumerate(whole.orderBy("ts").collect()) if r.b_ob is not None}
    # the close of row 9 passes the high of row 6: the lowest bar between is row 8
    assert shown == {8: (1, 9.0, 5.0, 27.0, 0, 8 / 19 * 100)}
    first = apply(b.where("ts < '2020-01-10'"), "order_blocks", "b", "k")
    shown = {i: tuple(r[n] for n in names) for i, r in enumerate(first.orderBy("ts").collect()) if r.b_ob is not None}
    assert shown == {4: (1, 11.0, 7.0, 15.0, 6, 4 / 11 * 100)}


def test_switch_beyond_its_slots_and_forward_fill(spark):
    b = bars(spark, i=[0, 1, None, 1], x=[1, None, 3, None], y=[5, 6, 7, 8])
    assert values(apply(b, "switch2_number", "s", "i", "x", "y"), "s") == [1.0, 6.0, None, 8.0]
    assert values(apply(b, "ffill_number", "f", "x"), "f") == [1.0, 1.0, 3.0, 3.0]
    for wrong in (-1.0, -2.0, 2.0):
        with pytest.raises(Exception, match="no slot"):
            apply(b.withColumn("i", F.lit(wrong)), "switch2_number", "s", "i", "x", "y").collect()


def test_feeds_are_checked(spark):
    b = bars(spark, c=[1, 2, 3])
    facts = b.where("c > 1").select("asset_id", "ts", F.lit("A").alias("ticker"), F.lit("1").alias("id"), *[F.lit(1.0).alias(x) for x in ("split_from", "split_to", "split_ratio")])
    assert values(feeds.with_feed_id(b, facts, "splits"), "S:split_ratio") == [None, 1.0, 1.0]
    with pytest.raises(ValueError, match="lacks"):
        feeds.with_feed_id(b, facts.drop("id"), "splits")
    with pytest.raises(ValueError, match="no dividend_type"):
        feeds.with_feed_id(b, facts, "dividends", dividend_type="??")


def plain_continuous(rows, rule, offset, direction, style):
    """The roll as a loop over one root's rows (ts, contract, expiry, price, v, oi)."""
    contracts = sorted({(r[2], r[1]) for r in rows})
    bars = {name: sorted(r for r in rows if r[1] == name) for _, name in contracts}
    expiry = {name: e for e, name in contracts}
    names = [name for _, name in contracts]
    at_or_after = lambda name, ts: next((r for r in bars[name] if r[0] >= ts), None)
    at, day, decided, front, back, held = 0, None, False, [], [], []
    for ts in sorted({r[0] for r in rows}):
        if ts.date() != day:
            day, decided = ts.date(), False
            while at < len(names) - 1 and ts > bars[names[at]][-1][0]:
                at += 1
            if ts >= bars[names[at]][0][0]:
                decided = True
                if at < len(names) - 1:
                    f = at_or_after(names[at], ts)
                    b = at_or_after(names[at + 1], ts) if ts >= bars[names[at + 1]][0][0] else f
                    e = expiry[names[at]]
                    if (
                        e <= day + dt.timedelta(days=offset) if rule == "last_trading_day"
                        else e.replace(day=1) + dt.timedelta(days=offset) == day if rule == "first_of_month"
                        else f and b and b[5] / f[5] >= 1 + offset / 100
                    ):
                        at += 1
        if not decided:
            continue
        nxt = names[min(at + 1, len(names) - 1)]
        f, b = at_or_after(names[at], ts), at_or_after(nxt if ts >= bars[nxt][0][0] else names[at], ts)
        if f and b:
            front.append(f), back.append(b), held.append((ts, names[at]))
    steps = [None if i == 0 or held[i][1] == held[i - 1][1] else (back[i][3] - front[i][3] if style == "difference" else back[i][3] / front[i][3]) for i in range(len(held))]
    out = []
    for i, (ts, name) in enumerate(held):
        mine = [x for x in (steps[i + 1 :] if direction == "backward" else steps[: i + 1]) if x is not None]
        out.append((ts, name, front[i][3] + sum(mine) if style == "difference" else front[i][3] * math.prod(mine)))
    return out


@pytest.mark.parametrize("rule,offset,direction,style", [("liquidity", 10, "backward", "difference"), ("liquidity", 0, "forward", "ratio"), ("last_trading_day", 2, "backward", "ratio"), ("first_of_month", 3, "forward", "difference")])
def test_continuous_futures(spark, rule, offset, direction, style):
    rng = random.Random(5)
    rows = []
    for root in ("A", "B"):
        for k in range(5):
            expiry = dt.date(2020, 2 + 2 * k, 20)
            for d in range(130):
                day = dt.datetime(expiry.year, expiry.month, expiry.day) - dt.timedelta(days=d)
                for hour in (9, 15):
                    if rng.random() < 0.9:
                        rows.append((root, day + dt.timedelta(hours=hour), f"{root}{k}", expiry, 100.0 + 5 * k + rng.random(), float(rng.randrange(1, 50)), float(1000 - abs(d - 60) * 10 + rng.randrange(100))))
    df = spark.createDataFrame([(r, t, c, e, p, p, p, p, v, oi) for r, t, c, e, p, v, oi in rows], "asset_id string, ts timestamp, contract string, expiry date, o double, h double, l double, c double, v double, oi double")
    got = futures.continuous(df, rule, offset, direction, style).collect()
    for root in ("A", "B"):
        expected = plain_continuous([r[1:] for r in rows if r[0] == root], rule, offset, direction, style)
        shown = sorted((r.ts, r.contract, r.c) for r in got if r.asset_id == root)
        assert [x[:2] for x in shown] == [x[:2] for x in expected]
        near([x[2] for x in shown], [x[2] for x in expected], 1e-9)
    assert len({r.contract for r in got}) > 4
    assert futures.continuous(df.where("false"), rule, offset, direction, style).count() == 0


def test_futures_query_rolls_each_root(spark):
    rows = entry.queries()["futures_continuation"](spark, SF).collect()
    fronts = {root: [r.contract for r in sorted(rows, key=lambda r: r.ts) if r.asset_id == root] for root in "ANR"}
    assert sum(map(len, fronts.values())) == len(rows) == len({(r.asset_id, r.ts) for r in rows})
    assert all(x == sorted(x) and len(set(x)) > 20 for x in fronts.values())


@pytest.mark.parametrize("name", ["candles_events", "candles_loose_events", "candles_loose_orders", "candles_orders"])
def test_candles_share_their_windows(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Window [") <= 3  # 63 before: deep enough to overflow the planner's stack


def test_shared_columns_follow_their_inputs(spark):
    rng = random.Random(3)
    b = bars(spark, **{x: [rng.uniform(9, 11) for _ in range(60)] for x in "ohlcv"})
    steps = [("engulfing_bull", "a", (), {"period": 3}), ("add", "c", ("c", 0.5), {}), ("engulfing_bull", "b", (), {"period": 3}), ("engulfing_bull", "d", (), {"period": 4, "body_long": 0.5})]
    one = b
    for name, out, inputs, options in steps:
        one = apply(one, name, out, *inputs, **options)
    got = chain(b, *steps)
    assert got.columns == one.columns
    assert [tuple(r) for r in got.orderBy("ts").collect()] == [tuple(r) for r in one.orderBy("ts").collect()]
    assert values(got, "a") != values(got, "b")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    ran = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    shown = lambda v: None if v is None or v != v else round(float(v), 3) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    expected = sorted([tuple(shown(row[columns.index(c)]) for c in sorted(columns)) for row in ran.fetchall()], key=str)
    got = sorted([tuple(shown(r[c]) for c in sorted(columns)) for r in df.collect()], key=str)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
