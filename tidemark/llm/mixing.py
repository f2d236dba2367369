"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, form blocks of BLOCK_ROWS rows. A
source of share a in a round of length L (the sum of the shares) puts a blocks into L
slots: its j-th block (from 0) is released at slot floor(j L / a) and due before slot
ceil((j + 1) L / a), and earliest deadline first fills the slots. Every source thus
stays within less than one block of its fluid share at every slot. A source with
fewer blocks left than its share takes what it has left as the share of that round,
one without blocks takes none, and the rest go on: nothing is dropped.

Rounds of equal shares have equal schedules, and there are at most twice as many
kinds of rounds as sources, so the schedules are made once for each kind, as SQL
expressions, and joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BLOCK_ROWS = 16
#: Slots in a round for every source that SHARES does not name, and for those it does.
DEFAULT_SHARE = 40
SHARES = {"src0": 120, "src1": 80, "src2": 80, "src3": 60, "src4": 60, "src19": 20}
#: Rows that one (source, bucket) gets to number, and the most buckets.
_BUCKET_ROWS, _MOST_BUCKETS = 1024, 16384
#: A round table larger than this is joined by shuffle, not by broadcast.
_BROADCAST_ROWS = 2_000_000

# One slot: among the sources whose next block is released, the one due first (ties: the
# earlier source) takes it. `let` binds the choice once.
_EDF = """
aggregate(
  sequence(0, int(length) - 1),
  named_struct('next', transform(shares, s -> 0), 'out', cast(array() as array<struct<i:int,j:int>>)),
  (acc, t) -> element_at(transform(
    array(array_min(transform(shares, (s, i) ->
      if(s > acc.next[i] and floor(acc.next[i] * length / s) <= t, struct(ceil((acc.next[i] + 1) * length / s) as due, i as i), null)))),
    pick -> named_struct(
      'next', transform(acc.next, (n, i) -> if(i = pick.i, n + 1, n)),
      'out', array_append(acc.out, struct(pick.i as i, acc.next[pick.i] as j)))), 1),
  acc -> acc.out)
"""


def _share(source: Column, shares: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, share in shares.items():
        out = F.when(source == name, share).otherwise(out)
    return out.cast("long")


def rounds(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sources(src, share, blocks) -> (its rows with their place i and the cuts, the
    kinds of rounds, their schedules).

    cuts: the rounds at which a kind begins. kinds(kind, first, length, shares, base):
    base is the slot at which the kind's first round begins. schedules(kind, i, j, at):
    the slot within the round of a source's j-th block."""
    one = sources.agg(F.array_sort(F.collect_list(F.struct("src", "share", "blocks"))).alias("s"))
    cuts = "array_sort(array_distinct(concat(array(0L), flatten(transform(s, x -> array(x.blocks div x.share, x.blocks div x.share + if(x.blocks % x.share > 0, 1, 0)))))))"
    one = cut(one.withColumn("cuts", F.expr(cuts)))
    placed = one.select("cuts", F.posexplode("s").alias("i", "x")).select("i", "x.*", "cuts")
    kinds = (
        one.select("s", "cuts", F.posexplode("cuts").alias("kind", "first"))
        .withColumn("shares", F.expr("transform(s, x -> least(x.share, greatest(0L, x.blocks - first * x.share)))"))
        .withColumn("length", F.expr("aggregate(shares, 0L, (a, x) -> a + x)"))
        .withColumn("times", F.expr("coalesce(get(cuts, kind + 1), first) - first"))
        .withColumn("base", F.coalesce(F.sum(F.col("times") * F.col("length")).over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("length > 0 and times > 0")
        .select("kind", "first", "length", "shares", "base")
    )
    kinds = cut(kinds.repartition("kind"))
    slots = kinds.select("kind", F.posexplode(F.expr(_EDF)).alias("at", "x")).select("kind", "at", "x.i", "x.j")
    return placed, kinds, slots


def _scheduled(docs: DataFrame, shares: dict[str, int] | None, default_share: int, block_rows: int, seed: int) -> DataFrame:
    """docs' rows as a struct __doc, so that no column of theirs meets one of ours, and
    their places in the mix."""
    n = docs.count()
    buckets = min(_MOST_BUCKETS, max(1, -(-n // _BUCKET_ROWS)))
    keyed = docs.select(
        F.struct(*docs.columns).alias("__doc"),
        F.col("doc_id").alias("__id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__draw"),
    ).withColumn("__bucket", F.pmod("__draw", F.lit(buckets)).cast("int"))
    filled = cut(keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("c")))
    sources = filled.groupBy("__source").agg(F.ceil(F.sum("c") / block_rows).cast("long").alias("blocks")).select(F.col("__source").alias("src"), _share(F.col("__source"), shares or {}, default_share).alias("share"), "blocks")
    placed, kinds, slots = rounds(sources)
    places = kinds.join(slots, "kind").select(
        "kind", "i", "j", "length", "base",
        F.expr("get(shares, i)").alias("a"), "at", "first",
    )
    table = cut(places.selectExpr("kind as __kind", "i as __i", "j as __j", "base as __base", "length as __length", "a as __a", "at as __at", "first as __first"))
    m = sources.count()
    rows_at_most = (2 * m + 1) * (m * default_share + sum((shares or {}).values()))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = filled.withColumn("__before", before).join(placed, F.col("__source") == F.col("src")).select("__source", "__bucket", "__before", F.col("i").alias("__i"), F.col("share").alias("__share"), F.col("cuts").alias("__cuts"))
    order = Window.partitionBy("__source", "__bucket").orderBy("__draw", "__id")
    at = keyed.withColumn("__nth", F.row_number().over(order) - 1).join(starts, ["__source", "__bucket"]).withColumn("__nth", F.col("__nth") + F.col("__before"))
    at = at.withColumns({"__block": F.expr(f"__nth div {block_rows}"), "__row": (F.col("__nth") % block_rows).cast("int")})
    at = at.withColumns({
        "__kind": F.expr("size(filter(__cuts, c -> c <= __block div __share)) - 1"),
        "__j": F.expr("int(__block - greatest(__block div __share, 0) * __share)"),
    })
    out = at.join(F.broadcast(table) if rows_at_most <= _BROADCAST_ROWS else table, ["__kind", "__i", "__j"])
    start = F.expr("__base + (__block div __share - __first) * __length")
    return out.select(
        "__doc", "__source", "__block", "__row",
        (start + F.col("__at")).alias("__slot"),
        (start + F.expr("floor(__j * __length / __a)")).alias("__release"),
        (start + F.expr("ceil((__j + 1) * __length / __a)")).alias("__deadline"),
    )


def mix(docs: DataFrame, shares: dict[str, int] | None = None, default_share: int = DEFAULT_SHARE, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """docs(doc_id, source, ...) -> its columns and __source (null: ''), __block (of the
    source, from 0), __row (in the block), __slot, __release, __deadline: the block
    keeps __release <= __slot < __deadline. Reading by (__slot, __row) gives the mix.

    Every row is returned once, whatever its nulls; rows that are equal in doc_id keep
    an order of their own, and columns of docs named like these are replaced. No rows: no
    rows. A large source is numbered in buckets, so
    no task takes it whole."""
    out = _scheduled(docs, shares, default_share, block_rows, seed)
    own = [c for c in out.columns if c != "__doc"]
    return out.select(*[F.col("__doc")[c].alias(c) for c in docs.columns if c not in own], *own)


def mixed(docs: DataFrame, shares: dict[str, int] | None = None, default_share: int = DEFAULT_SHARE, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """docs' rows and columns in the order of the mix: ranges of slots, in order within
    and over the partitions, so the files written are read in that order."""
    out = _scheduled(docs, shares, default_share, block_rows, seed)
    return out.repartitionByRange("__slot", "__row").sortWithinPartitions("__slot", "__row").select("__doc.*")
