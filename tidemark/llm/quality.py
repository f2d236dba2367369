"""Quality classifier: an interpolated modified Kneser-Ney model of characters.

Documents are packed into blocks of bounded size, in which a window of five characters is
named once however often it occurs. The trusted documents' counts are summed over all
blocks; every window that any block asks for stands in the same sharded table, with its
count or 0. Lower orders' continuation counts, contexts and the interpolation are
group-bys and equi-joins of such tables, and a last join by window gives each block the
probabilities it asked for, from which it reads off its documents' perplexities. Nothing
of the model passes through the driver or is broadcast, and it has every character and
window of the corpus. Documents above their language's quantile of held-out trusted
perplexity are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, written

ORDER = 5
#: One trusted document in FOLDS is held out of training to set the thresholds.
FOLDS = 5
#: A document is rejected above this quantile of its language. README.md has both errors.
QUANTILE = 0.98
#: Characters after which a block is closed (a document is never split), and characters
#: whose windows are made at once.
BLOCK_CHARS, _CHUNK = 32_000_000, 1_000_000
_START, _END = 1, 2


class _Windows:
    """The windows of a block's texts: names (the distinct ones), their counts, and each
    text's mean of weights that they are given."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        present = np.zeros(0x110000, bool)
        for s, _, _ in self._stretches():
            present[s] = True
        self.alphabet = np.flatnonzero(present).astype(np.uint32)
        self.rank = np.cumsum(present) - 1
        # codes of five characters fit 63 bits unless the alphabet is large; then the first
        # three are numbered by their order first
        self.heads = None
        if float(len(self.alphabet)) ** ORDER >= 2.0**63:
            self.heads = self._distinct(lambda x: self._code(x, 0, ORDER - 2))
        self.codes = self._distinct(self._codes)
        self.index = pd.Index(self.codes)

    def _stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """Code points of texts and parts of long texts between start and end marks; whether
        a window begins at each place; the text and number of windows of each part."""
        held, owners, n = [], [], 0
        for i, t in enumerate(self.texts):
            for at in range(0, len(t) + 1, _CHUNK):
                # windows at to at + _CHUNK of the marked text; the last one ends in the end mark
                part = t[max(0, at - ORDER + 1) : at + _CHUNK]
                points = [np.maximum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), 3)]
                if at == 0:
                    points.insert(0, np.full(ORDER - 1, _START, np.uint32))
                if at + _CHUNK > len(t):
                    points.append(np.full(1, _END, np.uint32))
                held += points
                windows = sum(map(len, points)) - ORDER + 1
                owners.append((i, windows))
                n += windows
                if n >= _CHUNK:
                    yield self._joined(held, owners)
                    held, owners, n = [], [], 0
        if held:
            yield self._joined(held, owners)

    @staticmethod
    def _joined(held: list[np.ndarray], owners: list[tuple[int, int]]):
        inside = np.repeat(np.tile([True, False], len(owners)), [x for _, n in owners for x in (n, ORDER - 1)])
        return np.concatenate(held), inside[: 1 - ORDER], owners

    def _code(self, x: np.ndarray, first: int, n: int) -> np.ndarray:
        size = len(x) - ORDER + 1
        out = x[first : first + size].copy()
        for k in range(first + 1, first + n):
            out = out * len(self.alphabet) + x[k : k + size]
        return out

    def _codes(self, x: np.ndarray) -> np.ndarray:
        if self.heads is None:
            return self._code(x, 0, ORDER)
        return np.searchsorted(self.heads, self._code(x, 0, ORDER - 2)) * len(self.alphabet) ** 2 + self._code(x, ORDER - 2, 2)

    def _places(self) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """The numbers of the windows of each stretch, in order, and its parts."""
        for s, inside, owners in self._stretches():
            yield self.index.get_indexer(self._codes(self.rank[s])[inside]), owners

    def _distinct(self, code) -> np.ndarray:
        out = np.zeros(0, np.int64)
        for s, inside, _ in self._stretches():
            out = pd.unique(np.concatenate([out, pd.unique(code(self.rank[s])[inside])]))
        return np.sort(out)

    def names(self) -> np.ndarray:
        """The distinct windows as strings, in the order of their codes."""
        n, c = len(self.alphabet), self.codes
        digits = []
        for _ in range(2):
            digits.append(c % n)
            c = c // n
        c = c if self.heads is None else self.heads[c]
        for _ in range(ORDER - 2):
            digits.append(c % n)
            c = c // n
        points = self.alphabet[np.stack(digits[::-1], axis=1)]
        return np.ascontiguousarray(points, dtype="<u4").view(f"<U{ORDER}").reshape(-1)

    def counts(self) -> np.ndarray:
        """How often each distinct window occurs."""
        out = np.zeros(len(self.codes), np.int64)
        for places, _ in self._places():
            out += np.bincount(places, minlength=len(out))
        return out

    def means(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each text's windows (weights: of the distinct ones)."""
        out = np.zeros(len(self.texts))
        for places, owners in self._places():
            text, n = np.array(owners).T
            np.add.at(out, text, np.add.reduceat(weights[places].astype(np.float64), np.cumsum(n) - n))
        return out / np.array([len(t) + 1 for t in self.texts])


def packed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) -> a row for each block of documents with text: block, ids,
    langs, keys (of the texts), texts (compressed), bytes (of each text), names (the
    windows). A block's rows are a partition's in their order, so the table has to be
    stored before it is used twice (bucketed by block, its joins do not move the texts)."""
    fields = ["block long", "ids array<long>", "langs array<string>", "keys array<long>", "texts binary", "bytes array<int>", "names array<string>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for rows in _blocks(batches):
            ids, langs, keys, texts = zip(*rows, strict=True)
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            row = [part << 32 | n, ids, langs, keys, _compressed(b"".join(data)), list(map(len, data)), _Windows(texts).names().tolist()]
            n += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in fields])

    return docs.where("text <> ''").select("doc_id", "lang", "key", "text").mapInArrow(run, ", ".join(fields))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows, in lists whose last columns have BLOCK_CHARS characters or little more."""
    held, n = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append(row)
            n += len(row[-1])
            if n >= BLOCK_CHARS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _compressed(data: bytes) -> bytes:
    """With copies found over the whole block."""
    how = zstandard.ZstdCompressionParameters.from_level(6, window_log=25, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=how).compress(data)


def _unpacked(texts: bytes, sizes: list[int]) -> list[str]:
    data, ends = zstandard.decompress(texts), np.cumsum([0, *sizes]).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:], strict=False)]


def window_counts(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(gram, c): every window of blocks, and how often the trusted(doc_id) documents have it."""
    ids = blocks.select("block", F.posexplode("ids").alias("at", "doc_id"))
    marked = ids.join(trusted, "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, sizes, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                every = _unpacked(texts, sizes)
                w = _Windows([every[i] for i in sorted(at)])
                yield pa.RecordBatch.from_arrays([pa.array(w.names().tolist(), pa.string()), pa.array(w.counts())], names=["gram", "c"])

    taught = blocks.select("block", "texts", "bytes").join(marked.hint("merge"), "block").select("texts", "bytes", "at").mapInArrow(run, "gram string, c long")
    asked = blocks.select(F.explode("names").alias("gram"), F.lit(0).cast("long").alias("c"))
    return asked.unionByName(taught).groupBy("gram").agg(F.sum("c").alias("c"))


def orders(counts: DataFrame) -> list[DataFrame]:
    """(gram, c) of each order from 1 on: the highest has counts, a lower one how many
    different characters stand before the window. Windows that are only asked for have 0."""
    out = [counts]
    for _ in range(ORDER - 1):
        out.append(cut(out[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.when(F.col("c") > 0, 1)).alias("c"))))
    return out[::-1]


def discounts(n: list[int]) -> list[float]:
    """The discounts of windows that occur once, twice and more often, from the numbers of
    those that occur 1, 2, 3 and 4 times (half the count where these are too few)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) if n[j - 1] and n[j] else 0.5 * j for j in (1, 2, 3)]


def kneser_ney(levels: list[DataFrame]) -> DataFrame:
    """orders' tables -> (gram, p): the probability of each window's last character after
    the others, interpolated down to a uniform one over the characters that occur."""
    few = [F.count(F.when(F.col("c") == j, 1)).alias(f"n{j}") for j in (1, 2, 3, 4)]
    figures = None
    for k, level in enumerate(levels, 1):
        one = level.agg(F.lit(k).alias("k"), *few, F.count("*").alias("size"), F.sum("c").alias("s"))
        figures = one if figures is None else figures.unionByName(one)
    by_order = {r["k"]: r for r in figures.collect()}  # a row for each order
    p = None
    for k, level in enumerate(levels, 1):
        f = by_order[k]
        d = discounts([f[f"n{j}"] for j in (1, 2, 3, 4)])
        c = F.col("c")
        level = level.withColumn("off", F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
        if k == 1:
            # one context: its figures are those of the order
            total = f["s"] or 0
            share = F.lit(1.0 / max(1, f["size"]))
            seen = level.agg(F.sum("off")).first()[0] or 0.0
            p = level.select("gram", ((c - F.col("off") + seen * share) / total if total else share).alias("p"))
            continue
        level = level.withColumns({"ctx": F.expr(f"substring(gram, 1, {k - 1})"), "low": F.expr("substring(gram, 2)")})
        ctx = level.where("c > 0").groupBy("ctx").agg(F.sum("c").alias("s"), (F.sum("off") / F.sum("c")).alias("gamma"))
        both = level.join(p.select(F.col("gram").alias("low"), F.col("p").alias("q")).hint("merge"), "low").join(ctx.hint("merge"), "ctx", "left")
        p = both.select("gram", F.coalesce((c - F.col("off")) / F.col("s") + F.col("gamma") * F.col("q"), "q").alias("p"))
    return p


def perplexities(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """blocks' documents -> doc_id, lang, key, perplexity. model: (gram, p)."""
    weight = model.select("gram", (-F.log(F.greatest("p", F.lit(1e-12)))).cast("float").alias("w"))
    asked = blocks.select("block", F.posexplode("names").alias("at", "gram"))
    given = asked.join(weight.hint("merge"), "gram").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, langs, keys, texts, sizes = (batch.column(k)[i].as_py() for k in range(5))
                means = _Windows(_unpacked(texts, sizes)).means(batch.column(5)[i].values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(np.exp(means), pa.float64())], names=["doc_id", "lang", "key", "perplexity"])

    joined = blocks.drop("names").join(given.hint("merge"), "block").select("ids", "langs", "keys", "texts", "bytes", "given")
    return joined.mapInArrow(run, "doc_id long, lang string, key long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled good and not toxic, once each."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()


def text_key() -> F.Column:
    """A row's text as a number."""
    return F.xxhash64(F.col("text").cast("string"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, lang, key (xxhash64 of the text), perplexity,
    threshold, kept, a row each.

    Trusted are the texts of all documents that labels call good and not toxic; folds
    1 to 4 of 5 train, fold 0 sets each language's threshold. A language without a
    held-out trusted text takes the threshold of all languages together (null, and
    then all is kept, if there is none at all). Null or empty texts have no
    perplexity and are kept: nothing speaks against them. Null doc_ids are scored and
    never trusted; repeated rows count as often as they occur."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), text_key().alias("key"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    with bucketed(packed(docs), "quality-blocks", "block") as blocks:
        levels = orders(written(window_counts(blocks, trusted_ids(labels).where(fold != 0)), "quality-counts"))
        scored = cut(perplexities(blocks, written(kneser_ney(levels), "quality-model")))
    sure = cut(scored.join(trusted_ids(labels).where(fold == 0), "doc_id", "left_semi").select("lang", "perplexity"))
    at = lambda: F.percentile_approx("perplexity", quantile, 10000)
    by = sure.groupBy("lang").agg(at().alias("own")).select(F.col("lang").alias("__lang"), "own")
    every = sure.agg(at().alias("all")).first()["all"]
    rest = docs.where("text is null or text = ''").select("doc_id", "lang", "key", F.lit(None).cast("double").alias("perplexity"))
    out = scored.unionByName(rest).join(by, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(every).cast("double")))
    return out.select("doc_id", "lang", "key", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected rows, all columns as they came. Rows that share a doc_id
    and differ in language or text are judged each by itself."""
    gone = score(docs, labels).where("not kept").select(F.col("doc_id").alias("__doc"), F.col("lang").alias("__lang"), F.col("key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & docs["lang"].cast("string").eqNullSafe(F.col("__lang")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    return docs.join(gone, same, "left_anti")
