"""Near-duplicate detection by min-max hashing.

Each permutation is evaluated once per shingle and gives two signature values, its
minimum and its maximum, so 72 hash evaluations make a signature of 144 values. 24
bands of 6 values (three permutations, their minima and maxima) find a pair of
similarity 0.85 with probability 1 - (1 - 0.85^6)^24: one in 8e4 is missed at the
threshold itself, one in 8e7 at 0.9. Other thresholds take as many bands as keep that
rate (38 at 0.8). Every pair that shares a band is then connected already, ruled out by
exact bounds, or compared on its full shingle sets.

The sides of the large joins grow with the corpus, so they are merge joins at every
size (hint), never broadcasts that turn into something else on larger input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import components

SHINGLE = 5
BAND_PERMUTATIONS = 3
#: The similarity of linked documents where none is given, in percent.
PERCENT = 85
#: The share of pairs at the threshold itself that may share no band.
MISSED = 1.2e-5
#: Rarer shingles that travel with one, to tell pairs that have met at one of them.
BEFORE = 8
#: Words whose hashes a task keeps at once, a matter of speed only.
_CACHE = 400_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SIG = "doc_id long, text_key long, n_shingles long, node long, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_for(percent: int) -> int:
    """How many bands find pairs of this similarity."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((min(percent, 99) / 100) ** (2 * BAND_PERMUTATIONS)))))


def _draws(seed: int, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    high = np.iinfo(np.uint64).max
    return (
        rng.integers(0, high, permutations, dtype=np.uint64) | np.uint64(1),
        rng.integers(0, high, permutations, dtype=np.uint64),
    )


class _Shingler:
    """The set of a text's shingles, as sorted distinct 64-bit hashes."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.words
        if len(known) > _CACHE:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        x, n = np.array(ids, dtype=np.uint64), len(ids)
        if n == 0:
            return x
        k = min(n, SHINGLE)
        out = np.full(n - k + 1, k, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = out * _MUL + x[i : n - k + 1 + i]
            return np.unique(_mix(out))


def _bands(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Band hashes from the minima and maxima of every permutation."""
    bands = len(a) // BAND_PERMUTATIONS
    lo = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    hi = np.zeros(len(a), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 8192):
            h = a[:, None] * x[None, i : i + 8192] + b[:, None]
            lo, hi = np.minimum(lo, h.min(axis=1)), np.maximum(hi, h.max(axis=1))
        rows = np.concatenate([lo.reshape(bands, -1), hi.reshape(bands, -1)], axis=1)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows.shape[1]):
            out = _mix(out * _MUL + rows[:, j])
    return out.view(np.int64)


def _node(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _text_key() -> F.Column:
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def signatures(docs: DataFrame, seed: int = 1, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands) of every row; text_key is xxhash64 of the
    text, node a 64-bit digest of the shingle set, null where there are no words."""
    width = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _draws(seed, width * BAND_PERMUTATIONS)
        shingles = _Shingler()
        for batch in batches:
            n, nodes, bands, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                x = shingles(text)
                n.append(len(x))
                nodes.append(_node(x))
                if len(x):
                    bands.append(_bands(x, a, b))
                ends.append(ends[-1] + (width if len(x) else 0))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "text_key", "n_shingles", "node", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), _text_key(), F.col("text").cast("string")).mapInArrow(run, _SIG)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs(text) -> (node, shingles): the full sets, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, sets)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose sets reach the similarity. sets(node, n, common):
    the number of all shingles, and those that another set has too."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("common").alias("sa")).hint("merge")
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("common").alias("sb")).hint("merge")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _can_link(n: str, m: str, k: str, j: str, percent: int) -> F.Column:
    """Whether sets of n and m shingles, k and j of them not theirs alone, can reach the
    similarity: they share min(k, j) at most."""
    share = F.least(k, j)
    return 100 * share >= percent * (F.col(n) + F.col(m) - share)


def _reduced(sets: DataFrame) -> DataFrame:
    """sets(node, shingles) -> (node, n, k, common): the k shingles that another of
    the sets has too, of the n, those that the fewest sets have first; what only one set
    has is shared by no pair."""
    one = sets.select("node", F.explode("shingles").alias("x"))
    twice = one.groupBy("x").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").cast("int").alias("df")).where("lo <> hi").select("x", "df")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda s: s["x"])
    kept = one.join(twice.hint("merge"), "x").groupBy("node").agg(ranked.alias("common"))
    size = sets.select("node", F.size("shingles").cast("long").alias("n"))
    return size.join(kept.hint("merge"), "node").select("node", "n", F.size("common").cast("long").alias("k"), "common")


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """sets(node, n, k, common, part) -> pairs(a, b) of different parts that can reach the
    similarity t, each found by a shingle among the rarest of both.

    Of two sets that reach t the larger one shares t of its n shingles at least, so one
    is among its (1 - t) n + 1 rarest; the smaller one shares 2 t / (1 + t) of its own, so
    that one is among its (1 - t) / (1 + t) n + 1 rarest (exact, in one order of all
    shingles). Shingles of a single set come first in that order and need no row. For
    each shingle the part with most sets meets the other parts only."""
    n = F.col("n")
    least_large = F.ceil(percent * n / 100)
    least_small = F.ceil(2 * percent * n / (100 + percent))
    wide, narrow = (F.greatest(F.lit(0), n - x + 1 - (n - F.col("k"))).cast("int") for x in (least_large, least_small))
    # a shingle travels with those before it in the order: two sets that share one of
    # them meet there already
    listed = sets.select("node", "n", "k", "part", narrow.alias("narrow"), F.slice("common", F.lit(1), wide).alias("rare"))
    post = listed.select("node", "n", "k", "part", "narrow", "rare", F.posexplode("rare").alias("at", "x"))
    post = post.withColumn("before", F.slice("rare", F.greatest(F.lit(1), F.col("at") + 1 - BEFORE), F.least(F.col("at"), F.lit(BEFORE)))).drop("rare")
    parts = post.groupBy("x", "part").agg(F.count("*").alias("m")).groupBy("x").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    post = cut(post.join(parts.select("x", "main").hint("merge"), "x"))
    rest = post.where("part <> main").toDF(*[f"{c}1" if c not in ("x", "main") else c for c in post.columns]).drop("main")
    others = post.toDF(*[f"{c}2" if c not in ("x", "main") else c for c in post.columns])
    apart = (F.col("part1") != F.col("part2")) & ((F.col("part2") == F.col("main")) | (F.col("node1") < F.col("node2"))) & _can_link("n1", "n2", "k1", "k2", percent)
    first_larger = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    small_has_it = F.when(first_larger, F.col("at2") < F.col("narrow2")).otherwise(F.col("at1") < F.col("narrow1"))
    # what stands before x in both is shared in vain, so the rest of both has to reach it
    left = F.least(F.col("k1") - F.col("at1"), F.col("k2") - F.col("at2"))
    reach = (100 * left >= percent * (F.col("n1") + F.col("n2") - left)) & ~F.arrays_overlap("before1", "before2")
    found = rest.join(others.hint("merge"), "x").where(apart & small_has_it & reach)
    return found.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, seed: int = 1, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, text_key, n_shingles, component_id,
    kept.
    Pairs whose similarity is at least percent in 100 are linked.

    Rows of equal shingle sets form a class; classes that share a band are candidates.
    Shingles that only one candidate has cannot be shared, so a candidate with more
    than 100 - percent in 100 of them links with nothing, and they bound every pair (exactly).
    First every candidate is compared with one center of each of its bands, the one
    with the least of its own, and the links give components. The members of bands that
    are then still in several components are compared where they share one of their
    rarest shingles (_rare_pairs, exact for these members, so no pair that shares a band
    stays unsettled): a large group of near copies costs little more than its size, and
    so do letters of one form as far as what fills them differs.

    Null or word-less texts: an empty set, linked with nothing, kept. Null doc_id: such
    rows link as others do and are kept only if no row of their component has an id.
    Rows that share a doc_id and differ in text are judged each by its own text. Other
    columns of docs are not read."""
    sig = written(signatures(docs, seed, percent), "minhash-signatures")
    # a doc_id spreads the rows of a text that occurs often
    place = F.coalesce("doc_id", "text_key").alias("place")
    classes = sig.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = written(banded.join(shared.hint("merge"), "bucket", "left_semi"), "minhash-members")

    texts = sig.where("node is not null").groupBy("node").agg(F.min(F.struct(place, "text_key")).alias("text"))
    needed = texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("text.place", "text.text_key").distinct()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key()).select(place, "text_key", "text")
    one_each = rows.join(needed.hint("merge"), ["place", "text_key"], "left_semi").dropDuplicates(["place", "text_key"])
    sets = written(_reduced(written(shingle_sets(one_each), "minhash-sets")).where(100 * F.col("k") >= percent * F.col("n")), "minhash-reduced")

    members = cut(members.select("bucket", "node").join(sets.select("node", "n", "k").hint("merge"), "node"))
    nearest = F.struct((1 - F.col("k") / F.col("n")).alias("own"), "node", "n", "k")
    centers = members.groupBy("bucket").agg(F.min(nearest).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.k").alias("ka"))
    first = members.join(centers.hint("merge"), "bucket").where((F.col("node") != F.col("a")) & _can_link("n", "na", "k", "ka", percent))
    first = cut(first.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    near = cut(components(_confirmed(first, sets, percent)))

    at = members.join(near, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_ = at.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    unsettled = at.join(open_.hint("merge"), "bucket", "left_semi").select("node", "part").distinct()
    pairs = _rare_pairs(sets.join(unsettled.hint("merge"), "node"), percent).join(first, ["a", "b"], "left_anti")
    more = _confirmed(pairs, sets, percent)
    lifted = more.join(near.toDF("a", "pa"), "a", "left").join(near.toDF("b", "pb"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    joined = cut(components(lifted))
    final = (
        near.toDF("node", "part").unionByName(joined.select("node", F.col("node").alias("part")))
        .groupBy("node").agg(F.min("part").alias("part"))
        .join(joined.toDF("part", "whole"), "part", "left")
        .select("node", F.coalesce("whole", "part").alias("component"))
    )
    # a component is named after its smallest doc_id
    firsts = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = cut(firsts.join(final.hint("merge"), "node"))
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    of_node = linked.join(names.hint("merge"), "component").select("node", "name")
    # stored, so that the join with all rows shuffles both sides and a hot set can be split
    named = cut(firsts.join(of_node.hint("merge"), "node", "left").select("node", F.coalesce("name", "first").alias("component_id")))
    out = ["doc_id", "text_key", "n_shingles", "component_id"]
    linkable = sig.where("node is not null").join(named.hint("merge"), "node").select(*out)
    empty = sig.where("node is null").withColumn("component_id", F.col("doc_id")).select(*out)
    return linkable.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, seed: int = 1, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that near_duplicates does not keep, each row by its own text;
    of rows that are equal in doc_id and text one stays. All columns are returned as they came."""
    kept = near_duplicates(docs, seed, percent)
    gone = kept.where(~F.col("kept")).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    return docs.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text"])
