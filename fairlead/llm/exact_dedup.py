"""Exact duplicates by static binary-fuse filters over immutable snapshots.

A snapshot is a stored table of distinct text digests, cut into shards by digest, and one binary-fuse filter per
shard. A new batch is reduced to its distinct digests (its own duplicates are grouped there, without the snapshot),
each digest is probed against the filter of its shard, and only the positives join the exact buckets of the snapshot,
where the normalised bytes of the two representatives are compared. Filters and shards keep a bounded size: their
number grows with the snapshot.

Texts are equal when they are identical after lower-casing A-Z only; null is the empty text.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, packed, same_id, stored_table

#: Digests per shard on average, and the fewest shards.
SHARD_KEYS = 65_536
LEAST_SHARDS = 64

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64())])


# -- binary-fuse filter ----------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class FuseFilter:
    """Three slots in consecutive segments hold an exclusive-or of 16 bits for every key."""

    seed: int
    segment: int
    segments: int
    slots: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mixed(keys, seed)
        starts = ((mixed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        second = _mixed(mixed, 1)
        mask = np.uint64(segment - 1)
        parts = [(mixed & mask), (second & mask), (second >> np.uint64(32)) & mask]
        places = np.stack([starts + k * segment + p.astype(np.int64) for k, p in enumerate(parts)], axis=1)
        return places, (second >> np.uint64(48)).astype(np.uint16) ^ (mixed >> np.uint64(16)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel the keys in rounds: a slot with one key left frees that key, all such slots at once."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        size_factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, int(np.ceil(n * size_factor / segment)))
        for seed in range(1, 1000):
            places, marks = cls.places(keys, seed, segment, segments)
            order = cls._peeled(places, segment * (segments + 2))
            if order is None:
                if seed % 8 == 0:  # very small sets may need more room
                    segments += 1
                continue
            slots = np.zeros(segment * (segments + 2), dtype=np.uint16)
            for who, where in reversed(order):
                own = places[who]
                slots[where] = 0
                slots[where] = marks[who] ^ slots[own[:, 0]] ^ slots[own[:, 1]] ^ slots[own[:, 2]]
            return cls(seed, segment, segments, slots)
        raise ValueError("no seed fits these keys")

    @staticmethod
    def _peeled(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n, order = len(places), []
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        np.bitwise_xor.at(owner, places.ravel(), np.repeat(np.arange(n), 3))
        left, alone = n, np.flatnonzero(count == 1)
        while len(alone):
            who, first = np.unique(owner[alone], return_index=True)
            where = alone[first]
            order.append((who, where))
            left -= len(who)
            touched = places[who].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.repeat(who, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        return None if left else order

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set and for about one other key in 65,536."""
        places, marks = self.places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return marks == self.slots[places[:, 0]] ^ self.slots[places[:, 1]] ^ self.slots[places[:, 2]]


# -- digests and snapshots -------------------------------------------------------------------------------------------


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for text in byte_texts(batch):
            digests.append(hashlib.sha256(text.lower()).digest())  # bytes.lower() touches A-Z only
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], schema=_DIGESTS)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes) of the normalised text of every row, stored."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digested, "doc_id long, digest binary, n_bytes long")
    return stored_table(rows, "digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows."""
    return rows.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("copies"))


@dataclass(frozen=True)
class Snapshot:
    """An immutable table of distinct digests with the filters of its shards."""

    distinct: DataFrame  # digest, n_bytes, last_id, copies, shard
    filters: DataFrame  # shard, seed, segment, segments, slots
    shards: int


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _keys(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v[:8] for v in values), dtype="<u8")


def _filter_of(rows: pd.DataFrame) -> pd.DataFrame:
    made = FuseFilter.build(_keys(rows["digest"]))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "seed": [made.seed], "segment": [made.segment], "segments": [made.segments], "slots": [made.slots.tobytes()]})


def snapshot(rows: DataFrame, shards: int | None = None) -> Snapshot:
    """Group the digests of a batch, store them, and build one filter per shard."""
    if shards is None:
        shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_KEYS))
    distinct = stored_table(distinct_digests(rows).withColumn("shard", shard_of(shards)), "snapshot")
    filters = distinct.select("shard", "digest").groupBy("shard").applyInPandas(_filter_of, "shard int, seed int, segment int, segments int, slots binary")
    return Snapshot(distinct, stored_table(filters, "filters"), shards)


def _probed(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(rows) and len(filters):
        f = filters.iloc[0]
        made = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["slots"], dtype=np.uint16))
        rows = rows.assign(maybe=made.holds(_keys(rows["digest"])))
    else:
        rows = rows.assign(maybe=False)
    return rows[["digest", "n_bytes", "last_id", "copies", "maybe"]]


def screened(distinct: DataFrame, known: Snapshot) -> DataFrame:
    """The distinct digests of a batch with ``maybe``: false means surely not in the snapshot."""
    rows = distinct.withColumn("shard", shard_of(known.shards))
    return rows.groupBy("shard").cogroup(known.filters.groupBy("shard")).applyInPandas(_probed, "digest binary, n_bytes long, last_id long, copies long, maybe boolean")


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((t.lower() for t in byte_texts(batch)), pa.binary())], names=["digest", "bytes"])


def _byte_checked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (digest, old_id, last_id), the digests whose representatives have the same normalised bytes."""
    wanted = pairs.select("digest", F.explode(F.array("old_id", "last_id")).alias("want"))
    # The wanted ids grow with the corpus: the join is the same at every size.
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), same_id(F.col("doc_id"), F.col("want")))
    lowered = texts.select("digest", "text").mapInArrow(_lowered, "digest binary, bytes binary")
    # Representatives of other digests may share an id when rows repeat it: only equal digests are compared.
    own = lowered.where(F.sha2("bytes", 256) == F.lower(F.hex("digest")))
    return own.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same")).where("same").select("digest")


def deduplicate(docs: DataFrame, is_known) -> DataFrame:
    """Exact duplicates of ``docs``; rows for which the condition ``is_known`` holds form the snapshot.

    Returns one row per input row: doc_id, keep_id (largest id of the equal texts, the row that stays), group_size,
    kept, text_sha256. The condition decides only which rows are filtered against which; the result does not depend
    on it. Rows that repeat a doc_id and its text all count in group_size and share the verdict (``without_duplicates``
    keeps one of them); a null doc_id is smaller than any other, and a group of null ids has a null keep_id. A null
    text is empty, and empty texts are equal. Empty input gives no rows. Other columns are ignored.
    """
    rows = digests(docs)
    known = snapshot(rows.where(is_known))
    fresh = stored_table(screened(distinct_digests(rows.where(~F.coalesce(is_known, F.lit(False)))), known), "screened")
    old = known.distinct.select("digest", F.col("last_id").alias("old_id"), F.col("copies").alias("old_copies"))
    hits = stored_table(fresh.where("maybe").join(old, "digest"), "hits")
    proven = _byte_checked(hits.select("digest", "old_id", "last_id"), docs)
    both = hits.join(proven, "digest").select("digest", F.greatest("last_id", "old_id").alias("keep_id"), (F.col("copies") + F.col("old_copies")).alias("group_size"))
    both = stored_table(both, "both")
    # Digests whose bytes differ (a collision) stay apart, one group on either side.
    sides = known.distinct.select("digest", "last_id", "copies", F.lit(True).alias("side")).unionByName(fresh.select("digest", "last_id", "copies", F.lit(False).alias("side")))
    alone = sides.join(both.select("digest"), "digest", "left_anti").select("digest", "side", F.col("last_id").alias("keep_id"), F.col("copies").alias("group_size"))
    groups = both.withColumn("side", F.explode(F.array(F.lit(True), F.lit(False)))).unionByName(alone)
    joined = rows.withColumn("side", F.coalesce(is_known, F.lit(False))).join(groups, ["digest", "side"])
    return joined.select("doc_id", "keep_id", "group_size", same_id(F.col("doc_id"), F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, is_known) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat an id and its text, one.

    An id may stand for several texts: each row is judged by its own.
    """
    from pyspark.sql import Window

    kept = deduplicate(docs, is_known).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).distinct()
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    own = packed(docs, id=F.col("doc_id").cast("long"), digest=F.sha2(lowered.cast("binary"), 256))
    rows = own.join(kept.hint("merge"), same_id(F.col("id"), F.col("kept_id")) & (F.col("digest") == F.col("kept_text")), "left_semi")
    same = Window.partitionBy("id", "digest").orderBy("row.text")
    return rows.withColumn("copy", F.row_number().over(same)).where("copy = 1").select("row.*")
