"""Periodic runs of words: stretches that repeat their first words at least four times, each told once and whole.

Internal pattern matching. A run of period q and length 4q or more holds an aligned block of b words, b being the
smallest power of two that is at least q, and this block occurs again q words on or q words back. All occurrences of a
block in a neighbouring window of its own length are one progression with its first member's distance as difference,
so the nearest occurrence gives the only candidate period. Blocks of all powers of two are looked up at once: prefix
doubling yields the suffix array and, level by level, the range of suffixes that begin with a block; the nearest start
behind or before the block is a range successor (count, then quantile) in the wavelet tree over the suffix array.
Candidates grow to both sides by common extensions, taken from the names of the levels, and stay if they are long
enough. Several texts share one array; their words have names of their own, so nothing matches across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts

#: Words of the texts that share one suffix array; a longer text has one of its own.
TOGETHER = 100_000


class Names:
    """Names of all stretches of 1, 2, 4, ... elements, and the suffix array they lead to."""

    def __init__(self, elements: np.ndarray, longest: int):
        n = len(elements)
        self.order = np.argsort(elements, kind="stable")
        self.levels: list[np.ndarray] = []
        #: Per level: the elements that are not alone with their name, and the size of their group.
        self.shared: list[tuple[np.ndarray, np.ndarray]] = []
        ranked = elements[self.order]
        at, new, rank, width = np.arange(n), np.ones(n, bool), np.empty(n, np.int64), 1
        new[1:] = ranked[1:] != ranked[:-1]
        while True:
            first = np.flatnonzero(new)
            sizes = np.diff(first, append=len(at))
            rank[self.order[at]] = np.repeat(at[first], sizes)
            size = np.repeat(sizes, sizes)
            at, size = at[size > 1], size[size > 1]
            self.levels.append(rank.astype(np.int32))
            self.shared.append((self.order[at], size))
            if not len(at) or 2 * width > longest:
                return
            place = self.order[at]
            key = rank[place] * n + rank[np.minimum(place + width, n - 1)]
            by_key = np.argsort(key, kind="stable")
            self.order[at], key = place[by_key], key[by_key]
            new, width = np.ones(len(at), bool), 2 * width
            new[1:] = key[1:] != key[:-1]

    def alike(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many elements from x and y on are equal; with ``back``, how many before x and y."""
        x, y, n, length = x.copy(), y.copy(), len(self.order), np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step, names, going = (-1 if back else 1) << level, self.levels[level], np.ones(len(x), bool)
            while going.any():
                u, v = (x + step, y + step) if back else (x, y)
                going &= (u >= 0) & (v >= 0) & (u < n) & (v < n)
                going[going] = names[u[going]] == names[v[going]]
                x, y, length = x + step * going, y + step * going, length + (1 << level) * going
                if level < len(self.levels) - 1:
                    break
        return length


class WaveletTree:
    """Counts and order statistics of ranges of an array of different numbers below its length, many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = range(max(len(values) - 1, 1).bit_length() - 1, -1, -1)
        self.zeros = []
        for bit in self.bits:
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of the ranges are smaller than the bounds."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            one, a, b = (bound >> bit & 1).astype(bool), zeros[low], zeros[high]
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def quantile(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The number-th smallest (from 0) of the ranges."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = number >= b - a
            number, found = np.where(one, number - (b - a), number), found | one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def nearest(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, back: bool) -> np.ndarray:
        """The smallest number above ``at`` in each range, or the largest below it; -1 if there is none."""
        number = self.below(low, high, at) - 1 if back else self.below(low, high, at + 1)
        there = (number >= 0) & (low + number < high)
        found = np.full(len(at), -1)
        found[there] = self.quantile(low[there], high[there], number[there])
        return found


def runs(elements: np.ndarray, local: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of texts that are parted by elements found only once.

    ``local`` is an element's place in its text and ``ends`` the place after the text's last element. A run is
    ``times`` (4 or more) times its period long and has ``least`` elements or more.
    """
    names = Names(elements, int(local.max(initial=0)) + 1)
    at, low, high, width = [], [], [], []
    for level, (place, size) in enumerate(names.shared):
        b = 1 << level
        block = (local[place] % b == 0) & (place + b <= ends[place])
        place, size = place[block], size[block]
        if level == 0:  # the windows of one word are its neighbours
            beside = np.zeros(len(elements) + 1, bool)
            beside[1:-1] = elements[1:] == elements[:-1]
            near = beside[place] | beside[place + 1]
            place, size = place[near], size[near]
        rank = names.levels[level][place].astype(np.int64)
        at.append(place)
        low.append(rank)
        high.append(rank + size)
        width.append(np.full(len(place), b))
    at, low, high, width = (np.concatenate(x) for x in (at, low, high, width))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    tree = WaveletTree(names.order)
    found = []
    for back in (False, True):
        other = tree.nearest(low, high, at, back)
        near = (other >= 0) & (np.abs(other - at) <= width)
        found.append(np.unique(np.stack([np.minimum(at, other), np.abs(other - at)], axis=1)[near], axis=0))
    start, period = np.unique(np.concatenate(found), axis=0).T
    before = names.alike(start, start + period, back=True)
    length = before + names.alike(start, start + period) + period
    long_ = length >= np.maximum(least, times * period)
    return np.unique(np.stack([(start - before)[long_], length[long_], period[long_]], axis=1), axis=0)


def _together(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of every text, found at once."""
    sizes = np.array([len(t) for t in texts])
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
    elements, name = np.empty(int((sizes + 1).sum()), np.int64), 0
    for first, words in zip(firsts.tolist(), texts, strict=True):
        index = {w: i for i, w in enumerate(dict.fromkeys(words), name)}
        elements[first : first + len(words)] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        elements[first + len(words)] = name + len(index)
        name += len(index) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    found = runs(elements, np.arange(len(elements)) - firsts[owner], (firsts + sizes)[owner])
    whose = owner[found[:, 0]]
    found[:, 0] -= firsts[whose]
    cuts = np.searchsorted(whose, np.arange(len(sizes) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run has after its first period."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (array of start, length, period, by start and period), collapsed (binary).

    Words are what stands between blanks, compared as they are. A run is a stretch of 6 words or more, at least four
    times its smallest period long, that neither neighbour continues; ``collapsed`` are the words, joined by one space,
    without those that some run has after its first period. A null, empty or blank text has no runs and an empty rest.
    Repeated rows repeat, null ids stay, other columns are ignored, and empty input gives no rows. A text is held whole
    by one task, with about 200 bytes a word.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0

            def flush() -> pa.RecordBatch:
                found = _together(texts)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
                spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                rest = pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), rest], names=["doc_id", "runs", "collapsed"])

            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                words = text.split()
                if texts and held + len(words) > TOGETHER:
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words) + 1
            if texts:
                yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
