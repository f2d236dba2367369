"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated query set, taken in blocks of bounded size, each broadcast;
every document meets every block, whole and in its own task, so no text is shuffled. An
alignment of m matches and e edits has e + 1 runs of matches at most, so one that reaches
the similarity has B = (2 similarity - 1) n - 1 of its item's n - 1 word bigrams at least.
The n - B bigrams that stand in the fewest places of the block are the item's seeds: the
stems that many items share are left out, and still each such alignment holds a seed
(items too short for that have single words as seeds). A document's seed hits, gathered
along diagonals, open windows of its words as wide as the gaps of such an alignment can
make them. Windows that have too few of the item's words to reach the similarity are left
out, which is exact; the others are aligned with the item. The result is that of aligning
every document with every item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: An alignment must score this share of the item's own.
SIMILARITY = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: A block's words; with it the broadcast is bounded.
BLOCK_WORDS = 1_000_000
_TRIM = ".,;:!?\"'()[]{}*#%$&|<>"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, without marks around them."""
    return [w for w in (x.strip(_TRIM) for x in (text or "").lower().split()) if w]


def gram_of(n: int, similarity: float) -> int:
    """The words of a seed of an item of n words."""
    # m matches and e edits reach it with e <= 2 m - 2 similarity n; two in a row if m > e + 1
    return 2 if n * (MATCH * similarity - 1) > 1 + 1e-9 else 1


def seeds_of(n: int, similarity: float) -> int:
    """How many of an item's bigrams have to be seeds: one more than can go unmatched."""
    return n - max(1, math.ceil((MATCH * similarity - 1) * n - 1 - 1e-9))


class _Block:
    """A block of items: word ids, and where each seed stands in which item."""

    def __init__(self, items: list[tuple[int, str]], similarity: float) -> None:
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            x = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if x:
                self.items.append((item, np.array(x, np.int64)))
        self.base = len(self.ids) + 1
        self.similarity = similarity
        size = [gram_of(len(x), similarity) for _, x in self.items]
        self.sizes = sorted(set(size))
        grams = [self.grams(x, k) for (_, x), k in zip(self.items, size, strict=True)]
        places = self._rarest(grams, size)
        grams = [g[p] for g, p in zip(grams, places, strict=True)]
        codes = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.seed_items = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.seed_places = np.concatenate(places)[order] if grams else codes
        self.seeds, self.first = np.unique(codes[order], return_index=True)
        self.n_places = np.diff(np.append(self.first, len(codes)))
        #: Each item's distinct words and how often it has them.
        self.words = [np.unique(x, return_counts=True) for _, x in self.items]

    def _rarest(self, grams: list[np.ndarray], size: list[int]) -> list[np.ndarray]:
        """The places of each item's seeds among its grams."""
        _, which, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True) if grams else ([], np.zeros(0, int), np.zeros(0, int))
        often = np.split(count[which], np.cumsum([len(g) for g in grams])[:-1]) if grams else []
        return [np.sort(np.argsort(f, kind="stable")[: seeds_of(len(f) + 1, self.similarity)]) if k == 2 else np.arange(len(f)) for f, k in zip(often, size, strict=True)]

    def grams(self, x: np.ndarray, k: int) -> np.ndarray:
        """Codes of the k-word windows, negative for single words; 0 where a word is in no item."""
        if k == 1:
            return -x
        return np.where((x[:-1] > 0) & (x[1:] > 0), x[:-1] * self.base + x[1:], 0)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of a document's seed hits and their diagonals, in that order."""
        at, seeds = [], []
        for k in self.sizes:
            g = self.grams(x, k)
            i = np.flatnonzero(g)
            j = np.minimum(np.searchsorted(self.seeds, g[i]), len(self.seeds) - 1)
            hit = self.seeds[j] == g[i]
            at.append(i[hit])
            seeds.append(j[hit])
        at, seeds = np.concatenate(at), np.concatenate(seeds)
        n = self.n_places[seeds]
        place = np.repeat(self.first[seeds] - np.cumsum(n) + n, n) + np.arange(n.sum())
        items, diagonals = self.seed_items[place], np.repeat(at, n) - self.seed_places[place]
        order = np.lexsort((diagonals, items))
        return items[order], diagonals[order]

    def shared(self, item: int, x: np.ndarray) -> int:
        """How many of the item's words could match one of x each."""
        words, n = self.words[item]
        s = np.sort(x)
        return int(np.minimum(n, np.searchsorted(s, words, "right") - np.searchsorted(s, words)).sum())

    def encode(self, text: str | None) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two sequences of word ids (0 matches nothing): its share
    of the item's own score, and the words [start, end) of doc that it spans."""
    n = len(doc)
    score = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best, span = 0, (0, 0)
    step = np.arange(n + 1)
    for w in item:
        hit = np.where((doc == w) & (w > 0), MATCH, MISMATCH)
        now, frm = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diag, up = score[:-1] + hit, score[1:] + GAP
        use = diag >= up
        now[1:], frm[1:] = np.where(use, diag, up), np.where(use, start[:-1], start[1:])
        frm = np.where(now > 0, frm, step)
        now = np.maximum(now, 0)
        run = now - GAP * step  # a gap in the item: the best of all cells to the left
        top = np.maximum.accumulate(run)
        where = np.maximum.accumulate(np.where(run == top, step, 0))
        gapped = top + GAP * step
        frm = np.where(gapped > now, frm[where], frm)
        score, start = np.maximum(now, gapped), frm
        j = int(score.argmax())
        if score[j] > best:
            best, span = int(score[j]), (int(start[j]), j)
    return best / (MATCH * max(1, len(item))), *span


def _found(block: _Block, x: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
    items, diagonals = block.hits(x)
    starts = np.flatnonzero(np.diff(items, prepend=-1))
    whole = np.bincount(x, minlength=block.base)
    for i, hits in zip(items[starts].tolist(), np.split(diagonals, starts[1:]), strict=bool(len(starts))):
        name, y = block.items[i]
        words, n = block.words[i]
        least = block.similarity * len(y) - 1e-9  # matches that an alignment must have
        if np.minimum(n, whole[words]).sum() < least:
            continue
        # with at most len(y) matches, more gaps than this end below the similarity
        slack = int(MATCH * (1 - block.similarity) * len(y) / -GAP) + 1
        cuts = np.flatnonzero(np.diff(hits) > slack)
        best = (0.0, 0, 0)
        for low, high in zip(hits[np.append(0, cuts + 1)].tolist(), hits[np.append(cuts, len(hits) - 1)].tolist(), strict=True):
            a, b = max(0, low - slack), min(len(x), high + len(y) + slack)
            if block.shared(i, x[a:b]) >= least:
                share, s, e = align(y, x[a:b])
                if share > best[0]:
                    best = (share, a + s, a + e)
        yield name, *best, len(hits)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, n = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and n + len(row[1].split()) > BLOCK_WORDS:
            yield held
            held, n = [], 0
        held.append((row[0], row[1]))
        n += len(row[1].split())
    if held:
        yield held


_FOUND = "doc_id long, key long, item_id long, score double, first_word long, end_word long, seeds long"


def _all_leaks(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """leaks' rows, with the key (xxhash64) of the text that each was found in. Each block's
    rows are stored, so that its broadcast can go before the next one is made."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), _key(docs).alias("key"), F.col("text").cast("string")).where("text is not null")
    out = spark.createDataFrame([], _FOUND)
    for items_of in _blocks(items):
        block = _Block(items_of, similarity)
        if not block.items:
            continue
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                rows = [(d, h, *f) for d, h, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for f in _found(b, b.encode(t)) if f[1] >= similarity]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

        out = out.unionByName(written(texts.mapInArrow(find, _FOUND), "leaks"))
        sent.destroy()
    return out


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> doc_id, item_id, score,
    first_word, end_word, seeds: one row for each document and item whose best local
    alignment scores at least similarity of the item's own (the words it spans in the
    document, from 0; the seed hits that led there).

    Null or empty texts on either side leak nothing, null item_ids are left out, and a
    null doc_id is returned as null. Repeated rows give one row, and so do rows that share
    a doc_id. No item or document is cut or left out."""
    best = F.max_by(F.struct("score", "first_word", "end_word", "seeds"), F.struct("score", "seeds", -F.col("first_word"))).alias("b")
    return _all_leaks(docs, items, similarity).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose text leaks an item, all columns as they came. Rows that
    share a doc_id, or have none, are judged each by its own text."""
    gone = _all_leaks(docs, items, similarity).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (_key(docs) == F.col("__key")), "left_anti")
