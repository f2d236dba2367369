"""Sharding by a two-pass external shuffle.

Pass one scatters all records by a seeded hash into memory-sized buckets. Pass two
takes each bucket into memory, puts it into a random order by Spark's own seeded
Fisher-Yates (`shuffle`), and numbers the whole. Equal stretches of that order are the
shards, so shard counts are at most one apart (the law `rows`). Where an order is given
that the shards have to keep, its stretches take the buckets' place (dealt()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARDS = 8
#: A bucket's expected bytes of text and overhead, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 256
#: A bucket of so many times the expected bytes is split.
_HOT = 4
#: The hot buckets are broadcast up to so many.
_BROADCAST_ROWS = 1_000_000
#: So many rows of a given order are shuffled among themselves.
STRETCH_ROWS = 256


def byte_size(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes."""
    got = docs.agg(F.count("*"), F.sum(byte_size())).first()
    return got[0], got[1] or 0


def shuffled(docs: DataFrame, seed: int = 1, total: int | None = None) -> DataFrame:
    """docs' columns and __place: their places from 0 in one random order of all rows.

    The order follows from the seed and the rows alone: their bytes (total, counted if it is
    not given) fix the number of buckets and partitions, and a bucket is sorted before it is
    shuffled, so a task that runs again gives the same order. Rows are drawn by doc_id and
    text; a bucket that rows equal in both overfill is split by the rows' numbers. No rows:
    no rows."""
    total = _sizes(docs)[1] if total is None else total
    buckets = max(-(-total // BUCKET_BYTES), LEAST_BUCKETS)
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string"))
    keyed = docs.withColumns({"__draw": draw, "__bytes": byte_size(), "__salt": F.xxhash64(F.lit(seed), F.monotonically_increasing_id())})
    keyed = keyed.withColumn("__bucket", F.pmod("__draw", F.lit(buckets)).cast("int"))
    filled = cut(keyed.groupBy("__bucket").agg(F.count("*").alias("c"), F.sum("__bytes").alias("b")))
    most = _HOT * max(total // buckets, 64 << 10)
    hot = filled.where(F.col("b") > most).select("__bucket", F.ceil(F.col("b") / (most // _HOT)).alias("__parts"))
    n_hot = hot.count()
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= _BROADCAST_ROWS else hot, "__bucket", "left")
        keyed = keyed.withColumn("__part", F.coalesce(F.pmod("__salt", "__parts"), F.lit(0)).cast("int"))
        filled = cut(keyed.groupBy("__bucket", "__part").agg(F.count("*").alias("c")))
    else:
        keyed, filled = keyed.withColumn("__part", F.lit(0)), filled.withColumn("__part", F.lit(0))
    bucket = ["__bucket", "__part"]
    before = F.coalesce(F.sum("c").over(Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(filled.select(*bucket, before.alias("__before")))
    whole = keyed.repartition(buckets, *bucket).sortWithinPartitions(*bucket, "__draw", "__salt").groupBy(*bucket).agg(F.collect_list(F.struct(*docs.columns)).alias("__rows"))
    dealt = whole.select(*bucket, F.posexplode(F.shuffle("__rows", F.lit(seed))).alias("__at", "__row"))
    return dealt.join(starts, bucket).select("__row.*", (F.col("__before") + F.col("__at")).alias("__place"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """docs' columns, shard (0 to shards - 1) and slot (gapless from 0 in each shard), of
    one random order of all rows cut into equal stretches. Columns shard and slot that
    docs has already are replaced."""
    docs = docs.drop("shard", "slot")
    rows, total = _sizes(docs)
    n = max(1, rows)
    out = shuffled(docs, seed, total).withColumn("__shard", F.expr(f"int(__place * {shards}L div {n}L)"))
    first = F.expr(f"(__shard * {n}L + {shards - 1}L) div {shards}L")
    return out.select(*[out[c] for c in docs.columns], F.col("__shard").alias("shard"), (F.col("__place") - first).cast("long").alias("slot"))


def dealt(docs: DataFrame, place: str, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """docs' columns without place, shard (0 to shards - 1) and slot (gapless from 0 in each
    shard), of an order that place numbers from 0 without gaps: stretches of STRETCH_ROWS
    are shuffled, and their rows dealt to the shards in turn. Every shard so has the order's
    mix from its first slot on, and shard counts are at most one apart. The order follows
    from the seed and the places. Columns shard and slot that docs has are replaced."""
    docs = docs.drop("shard", "slot")
    keyed = docs.withColumns({"__stretch": F.expr(f"`{place}` div {STRETCH_ROWS}L"), "__draw": F.xxhash64(F.lit(seed), F.col(place))})
    nth = F.row_number().over(Window.partitionBy("__stretch").orderBy("__draw", place))
    out = keyed.withColumn("__at", F.col("__stretch") * STRETCH_ROWS + nth - 1)
    own = [c for c in docs.columns if c != place]
    return out.select(*own, (F.col("__at") % shards).cast("int").alias("shard"), F.expr(f"__at div {shards}L").alias("slot"))
