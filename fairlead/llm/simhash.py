"""SimHash near-duplicates: fingerprints of word shingles, linked by Hamming distance through pivot distance tables.

Fingerprints are reduced to distinct ones. Two fingerprints that differ in at most d bits agree in at least two of
d + 2 blocks of bits, so both lie in one bucket named by a pair of blocks and their bits. In a bucket every
fingerprint has its row of the pivot table, the Hamming distances to many reference fingerprints; as a distance can
change by no more than the bits that differ, pairs whose largest coordinate difference exceeds d are discarded, and the
survivors are verified on the bits. A bucket hands on only a forest of its links, never its pairs. Buckets above a
bound are divided, and every two parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, packed, stored_table
from fairlead.llm.graph import components

#: Fingerprints of one bucket that meet in one task; larger buckets are divided.
BUCKET = 8_192
#: Reference fingerprints of the pivot table.
PIVOTS = 48
#: Shingles that are held as bits at once.
_AT_ONCE = 65_536


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of every shingle, repeats included; no words give zero."""
    import xxhash

    parts = text.lower().split()  # on the six ASCII white-space bytes; lower() touches A-Z only
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i : i + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long; null is the empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, words) for t in byte_texts(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, fp long")


def blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 2 blocks of nearly equal width."""
    edges = np.linspace(0, 64, distance + 3).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(64).integers(0, 2**64, size=count, dtype=np.uint64)


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


class _Forest:
    """Smallest label per row, merged link by link without keeping the links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self._root(a), self._root(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))

    def _root(self, rows: np.ndarray) -> np.ndarray:
        at = self.label[rows]
        while True:
            up = self.label[at]
            if (up == at).all():
                return at
            at = up

    def roots(self) -> np.ndarray:
        return self._root(np.arange(len(self.label)))


def near_pairs(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the row pairs (a, b), those within the distance: discard by the table, verify on the bits."""
    for first in range(0, table.shape[1], 8):
        if not len(a):
            break
        apart = np.abs(table[a, first : first + 8] - table[b, first : first + 8]).max(axis=1)
        a, b = a[apart <= distance], b[apart <= distance]
    close = np.bitwise_count(fps[a] ^ fps[b]) <= distance
    return a[close], b[close]


def _linked(key: np.ndarray, part: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Root row of every row, linking rows of one group; part 1 marks the side that meets only part 0."""
    table, forest = pivot_table(fps, pivots()), _Forest(len(fps))
    edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
    sizes = np.diff(edges)
    # Small groups all at once: each row meets the row that is `step` further on, while the group lasts.
    ends = np.repeat(edges[1:], sizes)
    small = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    step = 1
    while len(small):
        small = small[small + step < ends[small]]
        a, b = small, small + step
        meets = (part[a] != part[b]) | (part[a] < 0)
        forest.join(*near_pairs(fps, table, a[meets], b[meets], distance))
        step += 1
    for g in np.flatnonzero(sizes > 64):
        rows = np.arange(edges[g], edges[g + 1])
        whole = part[rows[0]] < 0
        left = rows if whole else rows[part[rows] == 0]
        right = rows if whole else rows[part[rows] == 1]
        # In the order of the first pivot only rows within the distance on that coordinate can be close.
        left, right = (x[np.argsort(table[x, 0], kind="stable")] for x in (left, right))
        low = np.searchsorted(table[right, 0], table[left, 0] - distance, "left")
        high = np.searchsorted(table[right, 0], table[left, 0] + distance, "right")
        for i in range(0, len(left), 256):
            lo, hi = low[i : i + 256].min(), high[i : i + 256].max()
            a, b = np.repeat(left[i : i + 256], hi - lo), np.tile(right[lo:hi], len(left[i : i + 256]))
            keep = a < b if whole else slice(None)
            forest.join(*near_pairs(fps, table, a[keep], b[keep], distance))
    return forest.roots()


def bucket_links(distinct: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the nodes of (fp, node) that keep together what is within the distance in a bucket."""
    keys = [
        F.lit(n).cast("long") * F.lit(1 << 48)
        + F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1).cast("long")) * F.lit(1 << v)
        + F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << v) - 1).cast("long"))
        for n, ((a, w), (b, v)) in enumerate(combinations(blocks(distance), 2))
    ]
    rows = distinct.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored_table(counts.where(F.col("n") > bucket).withColumn("parts", F.ceil(F.col("n") / bucket).cast("int")).drop("n"), "crowded")
    rows = rows.join(crowded, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # Part p of a divided bucket goes to the meetings (p, q) and (q, p), smaller part first.
    meetings = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, own).alias("i"), F.greatest(q, own).alias("j"), F.when(q == own, -1).when(own < q, 0).otherwise(1).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")))
    rows = rows.select("key", "node", "fp", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(meetings)).alias("m")).select("key", "m.i", "m.j", "m.side", "node", "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = np.stack([t["key"].to_numpy(), t["i"].to_numpy().astype(np.int64), t["j"].to_numpy().astype(np.int64)], axis=1)
        order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
        node = t["node"].to_numpy()[order]
        roots = _linked(key[order], t["side"].to_numpy()[order], t["fp"].to_numpy()[order].view(np.uint64), distance)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[roots[moved]])], names=["a", "b"])

    return rows.repartition("key", "i", "j").mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed long), component_id (smallest doc_id reachable over links).

    Fingerprints link at ``distance`` or fewer differing bits; equal fingerprints are linked. Texts without words,
    nulls included, have fingerprint zero and are linked like any other. Repeated rows repeat; a null doc_id is
    no member that others could be named by, and a fingerprint that only null ids have is its own component, with a
    null component_id. Empty input gives no rows. Other columns are ignored.
    """
    rows = stored_table(fingerprints(docs, words), "fingerprints")
    distinct = stored_table(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "distinct")
    labels = components(stored_table(bucket_links(distinct, distance), "pairs"))
    named = distinct.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its group, all columns; rows with a null doc_id stay."""
    kept = near_duplicates(docs, words, distance).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = packed(docs, id=F.col("doc_id").cast("long"))
    named = rows.where("id IS NOT NULL").join(kept.hint("merge"), F.col("id") == F.col("kept_id"), "left_semi")
    return named.unionByName(rows.where("id IS NULL")).select("row.*")
