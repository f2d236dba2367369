"""Transforms of one row: mathematics, comparison, logic, selection, casts, strings, dates."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import functions as F

from ..core import AT, CUM, fdiv, full, transform

TYPES = {"string": "string", "number": "double", "boolean": "boolean", "timestamp": "timestamp"}
# The named constants.
CONSTANTS = {
    "zero": 0.0, "one": 1.0, "negative_one": -1.0, "pi": math.pi, "e": math.e, "phi": (1 + 5**0.5) / 2, "sqrt2": 2**0.5, "sqrt3": 3**0.5,
    "sqrt5": 5**0.5, "ln2": math.log(2), "ln10": math.log(10), "log2e": 1 / math.log(2), "log10e": 1 / math.log(10),
}


def _register() -> None:
    for name, value in CONSTANTS.items():
        transform(name)(lambda s, value=value: F.lit(value))
    for name, value in (("bool_true", True), ("bool_false", False)):
        transform(name)(lambda s, value=value: F.lit(value))
    for kind, dtype in TYPES.items():
        transform(f"null_{kind}")(lambda s, dtype=dtype: F.lit(None).cast(dtype))
    for name in ("acos", "asin", "atan", "cos", "cosh", "sin", "sinh", "tan", "tanh", "abs", "exp", "sqrt"):
        transform(name)(lambda s, x, f=getattr(F, name): f(x.cast("double")))
    for name in ("ceil", "floor"):
        transform(name)(lambda s, x, f=getattr(F, name): f(x).cast("double"))
    log = {"ln": F.log, "log10": F.log10}
    for name, f in log.items():
        transform(name)(lambda s, x, f=f: F.when(x > 0, f(x.cast("double"))).when(x == 0, float("-inf")).when(x < 0, float("nan")))
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}
    for name, f in compare.items():
        transform(name)(lambda s, a, b, f=f: f(a, b))
        transform(f"previous_{name}")(lambda s, x, periods=1, f=f: f(x, s.lag(x, periods)))
        transform(f"highest_{name}")(lambda s, x, periods=14, f=f: f(x, full(periods, F.max(x), x)))
        transform(f"lowest_{name}")(lambda s, x, periods=14, f=f: f(x, full(periods, F.min(x), x)))
    both = lambda a, b, x: F.when(a.isNotNull() & b.isNotNull(), x)  # noqa: E731  null if either side is
    logic = {"logical_and": lambda a, b: a & b, "logical_or": lambda a, b: a | b, "logical_xor": lambda a, b: a != b, "logical_and_not": lambda a, b: a & ~b}
    for name, f in logic.items():
        transform(name)(lambda s, a, b, f=f: both(a, b, f(a, b)))
    for kind in TYPES:
        transform(f"boolean_select_{kind}")(lambda s, c, a, b: F.when(c, a).when(~c, b))
        transform(f"first_non_null_{kind}")(lambda s, *x: F.coalesce(*x))
        transform(f"conditional_select_{kind}")(_conditional)
        transform(f"percentile_select_{kind}")(_percentile_select)
        transform(f"lag_{kind}")(lambda s, x, period=1: s.lag(x, period))
        transform(f"ffill_{kind}")(_ffill)
        transform(f"alias_{kind}")(lambda s, x: x)
        for n in range(2, 6):
            transform(f"switch{n}_{kind}")(_switch)
    transform("alias_decimal", "alias_integer")(lambda s, x: x)
    for to, dtype in (("integer", "long"), ("decimal", "double"), ("string", "string"), ("timestamp", "timestamp")):
        transform(f"static_cast_to_{to}")(lambda s, x, dtype=dtype: x.cast(dtype))


def _conditional(s, *x):
    out = F.lit(None) if len(x) % 2 == 0 else x[-1]
    for i in reversed(range(0, len(x) - 1, 2)):
        out = F.when(x[i], x[i + 1]).otherwise(out)
    return out


def _switch(s, i, *slots):
    """The slot numbered i from 0; an i beyond the slots is an error, a null one gives null."""
    i = i.cast("int")
    wrong = F.raise_error(F.concat(F.lit("no slot "), i.cast("string")))
    return F.when((i < 0) | (i >= len(slots)), wrong).otherwise(F.get(F.array(*slots), i))


def _percentile_select(s, x, high, low, lookback=14, percentile=80):
    q = s.add(full(lookback, F.percentile(x, percentile / 100), x))
    return F.when(x >= q, high).when(x < q, low)


def _ffill(s, x):
    return F.last(x, ignorenulls=True).over(CUM())


_register()

transform("number", "text")(lambda s, value=None: F.lit(value))
transform("timestamp_scalar")(lambda s, value=None: F.lit(value).cast("timestamp"))
transform("add")(lambda s, a, b: a + b)
transform("sub")(lambda s, a, b: a - b)
transform("mul")(lambda s, a, b: a * b)
transform("div")(lambda s, a, b: fdiv(a, b))
transform("modulo")(lambda s, a, b: a - F.floor(fdiv(a, b)) * b)
transform("power_op")(lambda s, a, b: F.pow(a, b))
transform("round")(lambda s, x: F.round(x))
transform("trunc")(lambda s, x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"))
transform("todeg")(lambda s, x: F.degrees(x))
transform("torad")(lambda s, x: F.radians(x))
transform("logical_not")(lambda s, x: ~x)
transform("is_null")(lambda s, x: x.isNull())
transform("is_valid")(lambda s, x: x.isNotNull())
transform("is_zero")(lambda s, x: x == 0)
transform("is_one")(lambda s, x: x == 1)
transform("static_cast_to_boolean")(lambda s, x: x != 0)
transform("stringify")(lambda s, x: x.cast("string"))
transform("boolean_branch")(lambda s, x: {"true": x, "false": ~x})
transform("ratio_branch")(lambda s, x, threshold_high=1.5, threshold_low=0.5: {"high": x > threshold_high, "normal": (x >= threshold_low) & (x <= threshold_high), "low": x < threshold_low})
transform("agg_sum")(lambda s, *x: reduce(add, x))
transform("agg_mean")(lambda s, *x: reduce(add, x) / len(x))
transform("agg_min")(lambda s, *x: F.least(*x))
transform("agg_max")(lambda s, *x: F.greatest(*x))
transform("agg_all_of")(lambda s, *x: reduce(and_, x))
transform("agg_any_of")(lambda s, *x: reduce(or_, x))
transform("agg_none_of")(lambda s, *x: ~reduce(or_, x))
transform("agg_all_equal")(lambda s, *x: reduce(and_, [y == x[0] for y in x[1:]]))


@transform("agg_all_unique")
def all_unique(s, *x, compat=False):
    """Whether all inputs differ; compat compares with the first one only."""
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :] if not (compat and i)]
    return reduce(and_, [a != b for a, b in pairs])


# --- strings -------------------------------------------------------------------------
@transform("string_case")
def string_case(s, x, operation="upper"):
    if operation in ("upper", "lower"):
        return getattr(F, operation)(x)
    if operation == "capitalize":
        return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))
    chars = F.split(x, "")
    if operation == "swapcase":
        return F.array_join(F.transform(chars, lambda c: F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))), "")
    letter = lambda c: F.lower(c) != F.upper(c)  # noqa: E731  title: a letter after a non-letter
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & letter(F.get(chars, i - 1)), F.lower(c)).otherwise(F.upper(c))), "")


@transform("string_trim")
def string_trim(s, x, operation="trim", trim_chars=""):
    f = {"trim": F.btrim, "trim_left": F.ltrim, "left": F.ltrim, "trim_right": F.rtrim, "right": F.rtrim}[operation]
    return f(x, F.lit(trim_chars or " \t\n\r\x0b\x0c"))


transform("string_contains")(lambda s, x, operation="contains", pattern="": {"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[operation](x, F.lit(pattern)))
# Each check's pattern for the whole string.
CHECKS = {
    "is_alpha": r"^\p{L}+$", "is_digit": r"^\p{Nd}+$", "is_decimal": r"^\p{Nd}+$", "is_numeric": r"^[\p{Nd}\p{Nl}\p{No}]+$", "is_alnum": r"^[\p{L}\p{Nd}\p{Nl}\p{No}]+$",
    "is_upper": r"^(?=.*\p{Lu})[^\p{Ll}\p{Lt}]*$", "is_lower": r"^(?=.*\p{Ll})[^\p{Lu}\p{Lt}]*$", "is_title": r"^(?=.*\p{Lu})(?:\P{L}*\p{Lu}\p{Ll}*(?!\p{Lu}))+\P{L}*$",
    "is_space": r"^[\s\p{Z}]+$", "is_printable": r"^[^\p{C}\p{Zl}\p{Zp}]*$", "is_ascii": r"^[\x00-\x7F]*$",
}
transform("string_check")(lambda s, x, operation="is_alpha": x.rlike("(?s)" + CHECKS[operation if operation.startswith("is_") else f"is_{operation}"]))
transform("string_replace")(lambda s, x, pattern="", replacement="": F.replace(x, F.lit(pattern), F.lit(replacement)))
transform("string_length")(lambda s, x: F.length(x).cast("long"))
transform("string_reverse")(lambda s, x: F.reverse(x))

# --- dates ---------------------------------------------------------------------------
# Names in order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "day_of_week": F.weekday,
    "day_of_year": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear,
}


@transform("index_datetime_extract", "column_datetime_extract")
def datetime_extract(s, x=None, component="year"):
    x = F.col("ts") if x is None else x
    if component == "is_leap_year":
        y = F.year(x)
        return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return PARTS[component](x).cast("long")


@transform("datetime_diff")
def datetime_diff(s, a, b, unit="days"):
    """Boundaries of the unit between a and b."""
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    if unit in ("months", "quarters", "years"):
        part = {"months": F.lit(1), "quarters": F.lit(3), "years": F.lit(12)}[unit]
        at = lambda x: F.floor((F.year(x) * 12 + F.month(x) - 1) / part)
        return (months if unit == "months" else at(b) - at(a)).cast("long")
    one = {"weeks": "week", "days": "day"}.get(unit, unit.rstrip("s"))
    micros = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}[one]
    at = lambda x: F.unix_micros(F.date_trunc(one, x.cast("timestamp")))
    return F.floor((at(b) - at(a)) / micros).cast("long")


transform("day_of_week")(lambda s, weekday="Monday": F.weekday("ts") == WEEKDAYS.index(weekday))
transform("month_of_year")(lambda s, month="January": F.month("ts") == MONTHS.index(month) + 1)
transform("quarter")(lambda s, quarter="Q1": F.quarter("ts") == int(str(quarter).lstrip("Q")))


@transform("week_of_month")
def week_of_month(s, week="First", compat=False):
    """Whether the day is in that week of its month (days 1 to 7 are the first; compat:
    day 1 alone is). Last is the fifth."""
    target = ("First", "Second", "Third", "Fourth", "Last").index(week) + 1
    day = F.dayofmonth("ts")
    return (F.ceil((day - 1) / 7) + 1 == target) if compat else (F.floor((day - 1) / 7) + 1 == target)


@transform("turn_of_month")
def turn_of_month(s, days_before=1, days_after=1, compat=False):
    """Within the last days_before or first days_after rows of a month; compat takes the
    two sides the other way round, relative to the month's first row."""
    w = AT().partitionBy("asset_id", F.trunc("ts", "month")).orderBy("ts")
    first = F.row_number().over(w)
    last = F.count("*").over(AT().partitionBy("asset_id", F.trunc("ts", "month"))) - first + 1
    if compat:
        return (first <= days_before + 1) | (last <= days_after)
    return (last <= days_before) | (first <= days_after)


@transform("holiday")
def holiday(s, days_before=1, days_after=1, dates=()):
    """Within days of one of the given dates, the dates themselves left out."""
    d = F.to_date("ts")
    near = F.lit(False)
    for x in dates:
        gap = F.datediff(d, F.lit(x).cast("date"))
        near = near | ((gap >= -days_before) & (gap <= days_after) & (gap != 0))
    return near
