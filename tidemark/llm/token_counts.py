"""Token counts by prefix dynamic programming.

For byte-level BPE a sequence of tokens is the encoding of its bytes exactly when every
two neighbours are the encoding of theirs. So the encoding of a prefix ends in the one
token t that ends there and goes with the last token of the prefix before it, and

    count[i] = count[i - len(t)] + 1

gives the exact count at every prefix from left to right, without encoding any prefix
again. A text is cut into units, a run of white space with the run of other characters
behind it; no piece of the pre-tokenizer spans two of them, so a text's counts are the
running sum of its units', and a task remembers those of the units it has met.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, takewhile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Units and pieces, and token pairs, that a worker remembers, and the longest unit; a matter of speed only.
_CACHE, _CACHED_CHARS = 700_000, 48

_WS = r"\p{White_Space}"
_CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
#: The pre-tokenizer's pattern.
_PIECES = regex.compile(rf"{_CONTRACTION}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+")
# The characters with the property White_Space.
_BLANKS = r"\t-\r \x85\xa0  -     　"
_UNITS = re.compile(rf"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+")
_LEADING = re.compile(rf"[{_BLANKS}]*")
#: Longer tokens are looked up by their last bytes, those of up to so many bytes directly.
_TAIL = 4
_ONE = (1,)


@cache
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of every prefix, for a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(_byte_chars())}
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # a token's order: single bytes first, then as the merges make them
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.order = {as_bytes(t): i for i, t in enumerate(t for t in model["vocab"] if t not in self.special and len(t) == 1)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.order))]
        self.join: dict[tuple[int, int], int] = {}
        for x, y in pairs:
            x, y = as_bytes(x), as_bytes(y)
            if x + y not in self.order:
                self.order[x + y] = len(self.parts)
                self.parts.append((self.order[x], self.order[y]))
            self.join[self.order[x], self.order[y]] = self.order[x + y]
        #: The lengths, longest first, of the tokens that end in given bytes: of those
        #: longer than _TAIL by their last _TAIL bytes, of the others by their last two.
        tails: dict[tuple[bool, bytes], tuple[int, ...]] = {}
        for t in self.order:
            end = t[-_TAIL:] if len(t) > _TAIL else t[-2:]
            if len(t) > 1:
                key = (len(t) > _TAIL, end)
                tails[key] = tuple(sorted({*tails.get(key, ()), len(t)}, reverse=True))
        self.long = {end: sizes for (long_, end), sizes in tails.items() if long_}
        self.short = {end: (*sizes, 1) for (long_, end), sizes in tails.items() if not long_}
        self.pieces: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.sizes: dict[str, int] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b standing side by side.

        They are merged across their boundary if, while the merges that built them are
        undone latest first, the two parts at the boundary have a merge of their own
        that comes before the one just undone."""
        undone = len(self.parts)
        while True:
            made = self.join.get((a, b))
            if made is not None and made < undone:
                return False
            for later in (a > b, a <= b):
                if later:
                    undone, a, stuck = a, self.parts[a][1], self.parts[a][1] == a
                else:
                    undone, b, stuck = b + 1, self.parts[b][0], self.parts[b][0] == b
                if not stuck:
                    break
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """count[i] for every byte prefix of one piece, 0 at 0."""
        count, last = [0], [-1]
        order, fits, long_, short = self.order, self.fits, self.long, self.short
        if len(fits) > _CACHE:
            fits.clear()
        for i in range(1, len(data) + 1):
            sizes = short.get(data[i - 2 : i], _ONE) if i > 1 else _ONE
            if i > _TAIL and (more := long_.get(data[i - _TAIL : i])):
                sizes = more + sizes
            for size in sizes:
                j = i - size
                if j < 0 or (t := order.get(data[j:i])) is None:
                    continue
                if j:
                    pair = last[j] << 32 | t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._apart(last[j], t)
                    if not ok:
                        continue
                count.append(count[j] + 1)
                last.append(t)
                break
        return count

    def _chars(self, piece: str) -> list[int]:
        """count at every character's end of one piece."""
        data = piece.encode("utf-8", "surrogatepass")
        counts = self.piece(data)
        if len(data) == len(piece):
            return counts[1:]
        return [counts[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def size(self, unit: str) -> int:
        """The tokens of a unit."""
        n = self.sizes.get(unit)
        if n is None:
            n, known = 0, self.pieces
            for p in _PIECES.findall(unit):
                m = known.get(p)
                if m is None:
                    m = self.piece(p.encode("utf-8", "surrogatepass"))[-1]
                    if len(p) <= _CACHED_CHARS:
                        known[p] = m
                n += m
            if len(unit) <= _CACHED_CHARS:
                self.sizes[unit] = n
            if len(self.sizes) + len(known) > _CACHE:
                self.sizes.clear()
                known.clear()
        return n

    def unit(self, unit: str) -> list[int]:
        """The count at every character's end of a unit. Its white space is one piece until
        another character follows; a contraction is marks and letters until it is whole."""
        blanks = _LEADING.match(unit).end()
        out = self._chars(unit[:blanks])
        if blanks < len(unit):
            at = base = 0
            for m in _PIECES.finditer(unit):
                p = m[0]
                counts = self._chars(p)
                if len(p) == 3 and regex.fullmatch(_CONTRACTION, p):
                    counts[1] = counts[0] + self._chars(p[1])[0]
                out += [base + n for n in counts[max(0, blanks - at) :]]
                at, base = at + len(p), base + counts[-1]
        return out

    def _parts(self, text: str) -> list[str]:
        """The text, cut at special strings (each of them a part)."""
        if not self.split or not any(s in text for s in self.special):
            return [text]
        return [x for x in self.split.split(text) if x]

    def units(self, text: str) -> list[str]:
        """The units and special strings of a text."""
        return [u for p in self._parts(text) for u in ([p] if p in self.special else _UNITS.findall(p))]

    def sizes_of(self, units: list[str]) -> list[int]:
        """The tokens of every unit or special string."""
        known, special = self.sizes.get, self.special
        out = list(map(known, units))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = 1 if units[i] in special else self.size(units[i])
        return out

    def __call__(self, text: str) -> np.ndarray:
        """Counts at every prefix: n code points give n + 1 counts."""
        out, base, open_ = [0], 0, ""  # open_: the unit that the next part would go on
        for part in self._parts(text):
            if part in self.special:
                # inside the string it is text like any other, at its end one token
                started = sum(self.sizes_of(_UNITS.findall(open_)))
                inside, total = [], 0
                for u in _UNITS.findall(open_ + part):
                    inside += [total + n for n in self.unit(u)]
                    total = inside[-1]
                out += [base - started + n for n in inside[len(open_) :]]
                out[-1], base, open_ = base + 1, base + 1, ""
                continue
            for u in _UNITS.findall(part):
                out += [base + n for n in self.unit(u)]
                base, open_ = out[-1], u
        return np.array(out, np.int64)

    def count(self, text: str, limit: int) -> tuple[int, int]:
        """The tokens of a text, and the characters of its longest prefix of at most limit."""
        units = self.units(text)
        sizes = self.sizes_of(units)
        total = sum(sizes)
        if total <= limit:
            return total, len(text)
        # of the units that begin within the limit, the last one holds that prefix's end
        begun = sum(1 for _ in takewhile(lambda n: n <= limit, accumulate(sizes)))
        before = sum(map(len, units[:begun]))
        tail = "".join(units[begun - 1 : begun + 1]) if begun else units[0]
        start = before - (len(units[begun - 1]) if begun else 0)
        spent = sum(sizes[: begun - 1]) if begun else 0
        return total, start + int(np.flatnonzero(spent + self(tail) <= limit)[-1])


@cache
def counter_of(path: str) -> PrefixCounter:
    """One counter for all of a Python worker's tasks."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, counts: the exact token count at every prefix,
    from none to all of the text's code points (null text: as empty, [0])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                got = [counter(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in got])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got).astype(np.int32)))], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, counts array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit, fit_chars: the
    tokens of the whole text, whether they exceed limit, and the code points of its
    longest prefix that limit tokens hold; sums of its units' counts, and prefix counts
    of the unit at the limit.

    Counts are the tokenizer's own without added special tokens; special strings in a
    text count as its library takes them, one token each. Null and empty texts: 0.
    A text of any length is counted whole, in memory of some bytes a character; equal in
    result and linear in work for one run of blanks, line ends, marks or letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            n, fit = [], []
            for t in batch.column(2).to_pylist():
                tokens, chars = counter.count(t, limit)
                n.append(tokens)
                fit.append(chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def within_budget(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs with every text cut to its longest prefix of at most budget tokens."""
    fit = token_counts(docs, path, budget).select(F.col("doc_id").alias("__id"), "fit_chars").dropDuplicates(["__id"])
    out = docs.join(fit, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left")
    return out.select(*[F.expr("substring(text, 1, cast(fit_chars as int))").alias("text") if c == "text" else docs[c] for c in docs.columns])
