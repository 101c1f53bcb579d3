"""Line dedup: hash normalised lines and their sentences, group digests globally, keep the earliest occurrence.

Units are all lines with a word, whatever their length, and the sentences of a line that holds more than one, so that a
passage is found wherever in a line it was put. A sentence ends with the blanks after a full stop, question or exclamation
mark, or with one of the full-width marks. Only sentences shorter than ``LEAST_BYTES`` inside a line are no units, as they
are no evidence of copying; length is that of the normalised UTF-8 text, which needs no blanks between words.
Units are equal when they agree after lower-casing A-Z and after every run of ASCII white space has become one space,
none at the ends. Of equal units over all documents the one with the smallest (doc_id, offset) stays; null ids come
last. The others are removed with what ends them. Offsets are bytes of the original UTF-8 text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, same_id, stored_table

#: Length of the sentences inside a line that count, in bytes of their normalised text.
LEAST_BYTES = 40
#: Full-width marks that end a sentence without a blank.
MARKS = "。！？"
_ENDS = re.compile(rb"[.!?][ \t]+|" + b"|".join(m.encode() for m in MARKS))
_LAST = (1 << 63) - 1


def lines(text: bytes, least: int = LEAST_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised unit) of every unit of a text: each line, and then its sentences."""
    start = 0
    while start < len(text):
        end = text.find(b"\n", start) + 1 or len(text)
        line = text[start:end]
        whole = b" ".join(line.lower().split())
        if whole:
            yield start, end, whole
        if len(whole) > least:
            at = 0
            for stop in [*(m.end() for m in _ENDS.finditer(line)), len(line)]:
                unit = b" ".join(line[at:stop].lower().split())
                if len(unit) >= least and unit != whole:
                    yield start + at, start + stop, unit
                at = stop
        start = end


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order without those inside another one."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not found or end > found[-1][1]:
            found.append((start, end))
    return found


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given spans, which are in order."""
    edges = [0, *(e for span in spans for e in span), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, digest) of every unit, stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, digests = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                for start, end, normal in lines(text):
                    ids.append(doc_id)
                    starts.append(start)
                    ends.append(end)
                    digests.append(hashlib.blake2b(normal, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "start", "end", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, start long, end long, digest binary")
    return stored_table(rows, "units")


def repeated_units(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end, keep_doc_id, keep_start): every unit that goes, and the one that stays for it."""
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "start")
    # Only digests with several units go on; counts and minima are combined before they are exchanged.
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored_table(first.select("digest", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start")), "first-units")
    later = rows.join(first, "digest")
    stays = (F.coalesce("doc_id", F.lit(_LAST)) == F.col("keep_doc_id")) & (F.col("start") == F.col("keep_start"))
    return later.where(~stays).select("doc_id", "start", "end", "keep_doc_id", "keep_start")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units, removed (array of start, end in order), kept (the remaining text, bytes).

    A removed line stands for its sentences; no removed spans overlap.

    Null texts are empty and have no units. Rows that repeat a doc_id count as one document: the same spans go from
    each. Rows with a null doc_id share one place after all others. Empty input gives no rows. Other columns are
    ignored.
    """
    rows = units(docs)
    counts = rows.groupBy("doc_id").agg(F.countDistinct("start", "end").alias("n_units"))
    gone = repeated_units(rows).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    per_doc = counts.join(gone, same_id(counts.doc_id, gone.doc_id), "left").select(counts.doc_id.alias("_id"), "n_units", "removed")
    per_doc = stored_table(per_doc, "line-spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [outermost([(s["start"], s["end"]) for s in r.as_py() or []]) for r in batch.column(2)]
            kept = pa.array((without(t, s) if s else t for t, s in zip(byte_texts(batch), spans, strict=True)), pa.binary())
            removed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), removed, kept], names=["doc_id", "n_units", "removed", "kept"])

    joined = docs.select(F.col("doc_id").cast("long"), "text").join(per_doc.hint("merge"), same_id(F.col("doc_id"), F.col("_id")), "left")
    joined = joined.select("doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "removed", "text")
    return joined.mapInArrow(task, "doc_id long, n_units long, removed array<struct<start:long,end:long>>, kept binary")
