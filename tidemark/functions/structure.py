"""Market structure: swings, what breaks them, and levels of the bars before.

Swings look ahead, so these transforms serve batches, not streams. The swings
themselves, retracements and the bars before are windows; only the first later touch
of a level and the greedy clusters of liquidity need an asset's rows in a small loop.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import ALL, CUM, KEY, TS, W, transform
from ..operators.resample import label


@transform("swing_highs_lows")
def swing_highs_lows(s, swing_length=5):
    """Highs (1) and lows (-1) of the 2 * swing_length rows around a row, of neighbours of
    one kind only the most extreme (the first of equals); the first and last row close the
    sequence as opposites of their neighbours. An asset without a swing has only nulls."""
    around = W().rowsBetween(-(swing_length - 1), swing_length)
    whole = F.count(s.h).over(around) == 2 * swing_length
    kind = s.add(F.when(whole & (s.h == F.max(s.h).over(around)), 1).when(whole & (s.l == F.min(s.l).over(around)), -1))
    index = s.add(s.index())
    before = s.add(F.last(kind, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1)))
    run = s.add(F.sum(F.when(kind != F.coalesce(before, F.lit(0)), 1).otherwise(0)).over(CUM()))
    rank = s.add(F.when(kind.isNotNull(), F.struct(F.when(kind == 1, s.h).otherwise(-s.l), -index)))
    kept = s.add(F.when(rank == F.max(rank).over(Window.partitionBy(KEY, run)), kind))
    at = s.add(F.when(kept.isNotNull(), index))
    first, last = F.min_by(kept, at).over(ALL()), F.max_by(kept, at).over(ALL())
    swing = s.add(F.when(index == F.count("*").over(ALL()), -last).when(index == 1, -first).otherwise(kept))
    return {"high_low": swing, "level": F.when(swing == 1, s.h).when(swing == -1, s.l)}


def first_touch(s, side: Column, level: Column, above: Column, below: Column, wait: int, equal: bool = False) -> Column:
    """The number (from 0) of the first row, at least wait rows on, with above > level where
    side is 1, or below < level where it is -1 (equal: touching is enough); else null."""

    def run(given):
        found, levels = [None] * len(given), {1: [], -1: []}
        for j, (_, _, up, down) in enumerate(given):
            if j >= wait and given[j - wait][0] in levels and given[j - wait][1] == given[j - wait][1]:
                kind, value = given[j - wait][:2]
                heapq.heappush(levels[kind], (kind * value, j - wait))
            for kind, price in ((1, up), (-1, down)):
                waiting = levels[kind]
                while waiting and (kind * price > waiting[0][0] or (equal and kind * price == waiting[0][0])):
                    found[heapq.heappop(waiting)[1]] = j
        for x in found:
            yield (x,)

    side = F.coalesce(side, F.lit(0)).cast("int")
    return s.machine(run, [side, level.cast("double"), above, below], "row long")[0]


@transform("bos_choch")
def bos_choch(s, high_low, level, close_break=False):
    """Breaks of structure and changes of character, at the second of four alternating
    swings whose levels are in order; broken_index is the row (from 0) that passes the
    level, and a structure that a later one outruns, or that never breaks, is left out.
    Elsewhere all four are 0. Levels compare as doubles."""
    kind, level = s.add(high_low.cast("int")), s.add(level)
    swings = Window.partitionBy(KEY, kind.isNull()).orderBy(TS)
    near = {n: (s.add(F.lag(kind, -n).over(swings)), s.add(F.lag(level, -n).over(swings) * kind)) for n in (-1, 1, 2)}
    here = s.add(level * kind)  # levels signed by the middle swing: lows read as highs
    turns = (near[-1][0] == -kind) & (near[1][0] == -kind) & (near[2][0] == kind)
    (_, a), (_, c), (_, d) = near[-1], near[1], near[2]
    bos = s.add(F.when(turns & (a < c) & (c < here) & (here < d), kind).otherwise(0))
    choch = s.add(F.when(turns & (d > here) & (here > a) & (a > c), kind).otherwise(0))
    up, down = (s.c, s.c) if close_break else (s.h, s.l)
    broken = s.add(first_touch(s, s.add(bos + choch), level, up, down, 2))
    outrun = s.add(F.min(broken).over(W().rowsBetween(1, Window.unboundedFollowing)))
    stays = broken.isNotNull() & (outrun.isNull() | (broken < outrun))
    only = lambda x: F.when(stays, x).otherwise(0)
    return {"bos": only(bos), "choch": only(choch), "level": only(level), "broken_index": only(broken)}


@transform("liquidity")
def liquidity(s, high_low, level, range_percent=0.001):
    """Clusters of two or more swings of a kind within range_percent of the asset's whole
    range about the first of them, until a bar sweeps that band: kind, mean level, row of
    the last member and of the sweep (0: never), at the first member; else null."""
    span = s.add((F.max(s.h).over(ALL()) - F.min(s.l).over(ALL())) * range_percent)
    kind = s.add(F.coalesce(high_low.cast("int"), F.lit(0)))
    edge, level = s.add(level + kind * span), s.add(level)
    swept = s.add(first_touch(s, kind, edge, s.h, s.l, 1, equal=True))

    def run(given):
        out, used = [(None,) * 4] * len(given), set()
        for k in (1, -1):
            swings = [i for i, g in enumerate(given) if g[0] == k]
            for n, i in enumerate(swings):
                if i in used:
                    continue
                _, mid, width, end = given[i]
                members = [i]
                for j in swings[n + 1 :]:
                    if end == end and end is not None and j >= end:
                        break
                    if j not in used and mid - width <= given[j][1] <= mid + width:
                        members.append(j)
                        used.add(j)
                if len(members) > 1:
                    out[i] = (k, sum(given[m][1] for m in members) / len(members), members[-1], 0 if end is None or end != end else int(end))
        yield from out

    made = s.machine(run, [kind, level, span, swept], "kind long,level double,end long,swept long")
    return dict(zip(("liquidity", "level", "end", "swept"), made, strict=True))


@transform("retracements")
def retracements(s, high_low, level):
    """Direction since the last swing (1 after a high), the part of the way between the last
    high and low that is taken back, in percent to one place, and its deepest so far; all a
    row late, and 0 until after the third change of direction."""
    kind = s.add(high_low.cast("int"))
    since = lambda x: F.coalesce(F.last(x, ignorenulls=True).over(CUM()), F.lit(0))
    way = s.add(since(kind))
    top, bottom = s.add(since(F.when(kind == 1, level))), s.add(since(F.when(kind == -1, level)))
    turned = s.add(F.coalesce(way != s.lag(way), F.lit(True)))
    reach = F.when(F.abs(top - bottom) > 1e-10, F.abs(top - bottom))
    back = F.when((way == 1) & ~turned, (top - s.l) / (top - bottom)).when(way == -1, (s.h - bottom) / (top - bottom))
    now = s.add(F.coalesce(F.when(reach.isNotNull(), F.round(100 * back, 1)), F.lit(0.0)))
    run = s.add(F.sum(turned.cast("int")).over(CUM()))
    same = Window.partitionBy(KEY, run).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    deepest = s.add(F.greatest(F.max(now).over(same), F.lit(0.0)))
    late = [s.add(F.coalesce(s.lag(x), F.lit(0))) for x in (way, now, deepest)]
    change = s.add(F.coalesce(late[0] != s.lag(late[0]), F.lit(False)))
    changes = s.add(F.sum(change.cast("int")).over(CUM()))
    shown = (changes > 3) | ((changes == 3) & ~change)
    return {n: F.when(shown, x).otherwise(0) for n, x in zip(("direction", "current_retracement", "deepest_retracement"), late, strict=True)}


@transform("previous_high_low")
def previous_high_low(s, timeframe="1D"):
    """High and low of the last but one bar of a coarser timeframe that is labelled before
    the row, and whether a row since that bar came up has passed them. Null and false
    where there are no two such bars."""
    bar = s.df.groupBy(KEY, label(timeframe).alias(TS)).agg(F.struct(F.max("h").alias("h"), F.min("l").alias("l"), label_of(timeframe)).alias("__bar"))
    bar = bar.select(KEY, TS, F.lag("__bar").over(W()).alias("__bar"), F.lit(True).alias("__coarse"))
    both = s.df.withColumn("__coarse", F.lit(False)).unionByName(bar, allowMissingColumns=True)
    asof = Window.partitionBy(KEY).orderBy(TS, "__coarse").rowsBetween(Window.unboundedPreceding, -1)
    # the latest coarse row decides, even where it has no bar before it
    latest = F.last(F.when(F.col("__coarse"), F.struct("__bar")), ignorenulls=True).over(asof)
    s.df = both.withColumn("__latest", latest).where("not __coarse").drop("__bar", "__coarse")
    s.temporary.append("__latest")
    high, low = s.add(F.col("__latest.__bar.h")), s.add(F.col("__latest.__bar.l"))
    since = Window.partitionBy(KEY, s.add(F.col("__latest.__bar.at"))).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    passed = lambda x: F.coalesce(F.max(x).over(since), F.lit(False))
    return {"previous_high": high, "previous_low": low, "broken_high": passed(s.h > high), "broken_low": passed(s.l < low)}


def label_of(timeframe: str) -> Column:
    return F.max(label(timeframe)).alias("at")


@transform("order_blocks")
def order_blocks(s, high_low, close_mitigation=False):
    """Blocks of orders: a close beyond the last swing behind it (each swing once, and only
    where another swing of its kind follows) marks the extreme bar between the two, or the
    bar before where there is none between. ob is 1 above a high and -1 below a low;
    ob_volume that of the last three bars, percentage the weaker part of it against the
    stronger. A block is mitigated when a bar passes its far side (with close_mitigation
    its body does), and taken back when a later bar then passes its near side. The row
    (from 0) that mitigates is the bar's own for bearish blocks and the one before for
    bullish ones; 0 if none. Elsewhere all are null."""

    def run(given):
        found, alive, last, crossed = {}, {1: [], -1: []}, {1: None, -1: None}, set()
        final = {k: max((i for i, g in enumerate(given) if g[0] == k), default=-1) for k in (1, -1)}
        for i, (kind, o, h, l, c, v) in enumerate(given):  # noqa: E741
            for k in (1, -1):
                alive[k] = [b for b in alive[k] if _kept(found, b, k, i, (o, h, l, c), close_mitigation)]
            for k in (1, -1):
                at = last[k]
                if at is None or final[k] < i or at in crossed or not k * c > k * given[at][2 if k == 1 else 3]:
                    continue
                crossed.add(at)
                between = range(at + 1, i)
                if between:
                    side = 3 if k == 1 else 2
                    spot = max(between, key=lambda j: (-k * given[j][side], j))
                    top, bottom = given[spot][2], given[spot][3]
                else:
                    spot = i - 1
                    top, bottom = (given[spot][3], given[spot][2]) if k == 1 else (given[spot][2], given[spot][3])
                new, old = v + given[max(i - 1, 0)][5], given[max(i - 2, 0)][5]
                strength = 100.0 if max(new, old) == 0 else min(new, old) / max(new, old) * 100
                done = found.get(spot, {"broken": False, "index": 0})
                found[spot] = done | {"ob": k, "top": top, "bottom": bottom, "volume": new + old, "percentage": strength}
                alive[k].append(spot)
            if kind in (1, -1):
                last[kind] = i
        for i in range(len(given)):
            b = found.get(i)
            yield (b["ob"], b["top"], b["bottom"], b["volume"], b["index"], b["percentage"]) if b else (None,) * 6

    kind = s.add(F.coalesce(high_low.cast("int"), F.lit(0)))
    made = s.machine(run, [kind, s.o, s.h, s.l, s.c, s.v], "ob long,top double,bottom double,volume double,index long,percentage double")
    return dict(zip(("ob", "top", "bottom", "ob_volume", "mitigated_index", "percentage"), made, strict=True))


def _kept(found: dict, spot: int, k: int, i: int, bar: tuple, by_body: bool) -> bool:
    """Whether a block lives on after a bar, which may mitigate it or take it back."""
    b, (o, h, l, c) = found.get(spot), bar  # noqa: E741
    if b is None:
        return False
    if b["broken"]:
        if h > b["top"] if k == 1 else l < b["bottom"]:
            del found[spot]
            return False
    elif (min(o, c) if by_body else l) < b["bottom"] if k == 1 else (max(o, c) if by_body else h) > b["top"]:
        b["broken"], b["index"] = True, i - 1 if k == 1 else i
    return True
