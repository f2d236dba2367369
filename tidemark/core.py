"""Bars, windows and the registry of transforms.

Bars are one long DataFrame per timeframe: asset_id, ts and the columns o, h, l, c, v
(more are allowed), unique in (asset_id, ts). A transform adds columns to such a frame:

    apply(bars, "sma", "fast", "c", period=10)
    apply(bars, "bbands", "bb", "c")      # bb_lower, bb_middle, bb_upper

Transforms are functions of a Steps object, input columns and options that return a
Column, or a dict of Columns by output handle. Steps holds the frame and gives
intermediate columns names, since Spark nests no window in another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

KEY, TS = "asset_id", "ts"


def W() -> Window:  # noqa: N802
    """An asset's rows in order of time."""
    return Window.partitionBy(KEY).orderBy(TS)


def CUM() -> Window:  # noqa: N802
    """An asset's rows so far."""
    return W().rowsBetween(Window.unboundedPreceding, 0)


def ALL() -> Window:  # noqa: N802
    """All rows of an asset."""
    return Window.partitionBy(KEY)


def AT() -> Window:  # noqa: N802
    """All assets' rows of a time."""
    return Window.partitionBy(TS)


_names = count()

REGISTRY: dict[str, Callable] = {}


def transform(*ids: str) -> Callable:
    """Register a transform under its ids."""

    def put(f: Callable) -> Callable:
        for name in ids:
            REGISTRY[name] = f
        return f

    return put


def rows(n: int) -> Window:
    """The window of the last n rows."""
    return W().rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, x: Column) -> Column:
    """value over the last n rows where all n have an x, else null."""
    return F.when(F.count(x).over(rows(n)) == n, value.over(rows(n)))


def fdiv(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN, nulls stay null."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero)


def as_column(x: str | Column | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


class Steps:
    """A frame on which a transform builds intermediate columns."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.temporary, self.shared = df, [], {}
        self.o, self.h, self.l, self.c, self.v = (F.col(x) for x in "ohlcv")

    def add(self, x: Column) -> Column:
        """x as a column of its own, so that windows can be put over it."""
        name = f"__step{next(_names)}"
        self.df = self.df.withColumn(name, x)
        self.temporary.append(name)
        return F.col(name)

    def once(self, key: tuple, made: Callable[[], list[Column]]) -> list[Column]:
        """made()'s columns, added together (those over one window are one operator) and kept
        for the later steps of a chain that ask for the same key."""
        if key not in self.shared:
            names = {f"__step{next(_names)}": x for x in made()}
            self.df = self.df.withColumns(names)
            self.shared[key] = list(names)
        return [F.col(x) for x in self.shared[key]]

    def put(self, named: dict[str, Column]) -> None:
        """A step's outputs; its intermediate columns go. Shared ones stay, unless an output
        takes the place of a column that they may come from."""
        before = {x.lower() for x in self.df.columns}
        gone, self.temporary = self.temporary, []
        if any(x.lower() in before for x in named):
            gone, self.shared = gone + [x for xs in self.shared.values() for x in xs], {}
        self.df = self.df.withColumns(named).drop(*gone) if gone else self.df.withColumns(named)

    def _named(self, x: Column) -> str:
        self.add(x)
        return self.temporary[-1]

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(W())

    def index(self) -> Column:
        """The row's number from 1 within its asset."""
        return F.row_number().over(W())

    def scan(self, *chains: tuple[Column, Column, Column]) -> list[Column]:
        """y = keep * y_before + add for each (keep, add, seed); y starts at the first
        row whose seed is not null, as that seed; a row with null keep or add repeats y.
        The one loop over rows that recurrences need; all else about them is columns."""
        names, inputs = [], []
        for keep, add, seed in chains:
            inputs += [self._named(x.cast("double")) for x in (keep, add, seed)]
            names.append(f"__step{next(_names)}")
        fields, schema = inputs, StructType(list(self.df.schema))
        for name in names:
            schema = schema.add(name, "double")

        def run(group):
            group = group.sort_values(TS, kind="stable")
            for i, name in enumerate(names):
                y, out = None, []
                for a, b, s in zip(*(group[f].tolist() for f in fields[3 * i : 3 * i + 3]), strict=True):
                    if y is None:
                        y = None if s is None or s != s else s
                    elif a == a and b == b and a is not None and b is not None:
                        y = a * y + b
                    out.append(y)
                group[name] = out
            return group

        self.df = self.df.groupBy(KEY).applyInPandas(run, schema)
        self.temporary += names
        return [F.col(n) for n in names]

    def machine(self, step: Callable[[list], Iterator[tuple]], inputs: list[Column], outputs: str) -> list[Column]:
        """A small state machine over an asset's rows in order: step takes the rows' input
        tuples and yields a tuple of outputs for each (outputs: a schema string)."""
        fields = [self._named(x) for x in inputs]
        schema, names, asked = StructType(list(self.df.schema)), [], outputs.split(",")
        for x in asked:
            names.append(f"__step{next(_names)}")
            schema = schema.add(names[-1], x.split()[1])

        def run(group):
            group = group.sort_values(TS, kind="stable")
            made = list(step(list(zip(*(group[f].tolist() for f in fields), strict=True))))
            for i, (name, x) in enumerate(zip(names, asked, strict=True)):
                values = [m[i] for m in made]
                group[name] = values
                if x.split()[1] in ("long", "int"):
                    group[name] = group[name].astype("Int64")
            return group

        self.df = self.df.groupBy(KEY).applyInPandas(run, schema)
        self.temporary += names
        return [F.col(n) for n in names]


def chain(df: DataFrame, *steps: tuple) -> DataFrame:
    """df with the outputs of (transform, out, inputs, options) steps, one after another:
    out, or out_<handle> where a transform has several."""
    s = Steps(df)
    for name, out, inputs, options in steps:
        made = REGISTRY[name](s, *map(as_column, inputs), **options)
        made = made if isinstance(made, dict) else {"": made}
        s.put({f"{out}_{k}" if k else out: x for k, x in made.items()})
    return s.df.drop(*[x for xs in s.shared.values() for x in xs])


def apply(df: DataFrame, name: str, out: str, *inputs: str | Column | float, **options) -> DataFrame:
    """df with one transform's outputs."""
    return chain(df, (name, out, inputs, options))


def on_valid(df: DataFrame, name: str, out: str, *inputs: str, **options) -> DataFrame:
    """apply() on the rows where all inputs are non-null, aligned back to every row:
    windows then count valid rows, and the others get null."""
    before = df.columns
    made = apply(df.dropna(subset=[x for x in inputs if isinstance(x, str)]), name, out, *inputs, **options)
    added = [c for c in made.columns if c not in before]
    return df.join(made.select(KEY, TS, *added), [KEY, TS], "left")
