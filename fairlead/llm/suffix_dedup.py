"""Repeated byte strings by blockwise suffix sorting with ranks of a cover sample.

Every window of ``length`` bytes has an anchor, the leftmost of its shortest strings of ``ANCHOR`` bytes that hashes
lowest. The anchors are the cover sample: as with a difference cover, two equal windows are sampled at the same shift.
(A cover by position would sample three times as many places.) Consecutive windows with one anchor form a piece, the
anchor with its context. Pieces are dealt to buckets by anchor, and one bucket is sorted at a time: the sample is ranked
by what follows the anchor and by what precedes it, and the common lengths of neighbours in these two orders name the
classes at every depth. The class of a window is the pair of names at its two depths, so ties of any length are resolved
by ranks, and a task never holds more than a bucket. Nothing is decided by a hash.

Equal pieces of one part of the input travel once, for the smallest id there, with the runs of places where they stand
under it; those of larger ids are settled in the part. So a bucket sees a window at most once for every part and id,
however often it occurs. Anchors that a sample of the documents shows to be frequent are dealt by whole
windows instead; which ones are chosen changes the dealing, not the result. The corpus is dealt in ``SLICES`` rounds to
bound the disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, same_id, stored_table

LENGTH = 50
ANCHOR = 12
#: Bytes of text that are sampled at once, and rounds in which the corpus is dealt.
AT_ONCE = 3 << 20
SLICES = 2
#: Bytes of text for every bucket, and bytes of pieces that a map task gathers before it hands them on.
BUCKET_BYTES = 6 << 20
GATHERED = 40 << 20
#: One document in so many is looked at for frequent anchors, which hold more than so many pieces.
LOOKED_AT = 16
FREQUENT = 1_024
#: The most anchors that travel with the tasks as frequent (8 MB); any other holds less than that share of the pieces.
MOST_FREQUENT = 1 << 20
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; the data ends in padding."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    for r in range(8):
        part = np.frombuffer(data, "<u8", count=(len(data) - r) // 8, offset=r)
        own = out[r::8]
        own[:] = part[: len(own)]
    return out


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of ``width`` values from every place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[: len(values) - step], values[step:])
        done += step
    return values


class Pieces:
    """Windows with a common anchor: where they start, how many, how far behind the first the anchor lies."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        """``data`` holds the texts one after the other, ``offsets`` where each starts and the last one ends."""
        self.data = np.concatenate([data, np.zeros(length + 104, np.uint8)])
        self.eights = _eights(self.data)
        e, width = self.eights, length - ANCHOR + 1
        n = len(data)
        h = e[: n + length] * np.uint64(0xC2B2AE3D27D4EB4F) ^ e[ANCHOR - 8 : n + length + ANCHOR - 8] * np.uint64(0x165667B19E3779F9)
        h = _mixed(h)
        low = _sliding(h, width, np.minimum)
        first, last = offsets[:-1], offsets[1:] - length
        some = last >= first
        first, last = first[some], last[some]
        change = np.empty(n + 2, bool)
        change[0], change[1:] = True, low[1 : n + 2] != low[: n + 1]
        change[first] = True
        change[last + 1] = True
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n + 2) - 1
        doc = np.searchsorted(first, starts, "right") - 1
        inside = (doc >= 0) & (len(last) > 0)
        inside[inside] = starts[inside] <= last[doc[inside]]
        starts, ends = starts[inside], ends[inside]
        # A place is an anchor for some window exactly when it equals the greatest low of the windows around it.
        high = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), low[: n + 2]]), width, np.maximum)
        anchors = np.flatnonzero(h[: n + 2] == high[: n + 2])
        a, b = np.searchsorted(anchors, starts), np.searchsorted(anchors, ends + width - 1, "right")
        run = np.repeat(np.arange(len(starts)), b - a)
        place = anchors[np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        own = h[place] == low[starts[run]]
        run, place = run[own], place[own]
        before = np.empty(len(run), np.int64)
        if len(run):
            before[0], before[1:] = -1, np.where(run[1:] == run[:-1], place[:-1], -1)
        begin, end = np.maximum(starts[run], before + 1), np.minimum(ends[run], place)
        real = begin <= end
        self.start, self.windows, self.left = begin[real], (end - begin + 1)[real], (place - begin)[real]
        self.key = _mixed(h[place[real]] + np.uint64(1))
        self.length = length

    def split(self, frequent: np.ndarray) -> None:
        """Cut the pieces of frequent anchors into single windows, dealt by their whole content."""
        if not len(frequent) or not len(self.key):
            return
        at = np.minimum(np.searchsorted(frequent, self.key), len(frequent) - 1)
        cut = frequent[at] == self.key
        many = self.windows[cut]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, left = np.repeat(self.start[cut], many) + inner, np.repeat(self.left[cut], many) - inner
        key = np.zeros(len(start), np.uint64)
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            key = _mixed(key + self.eights[start + k] * np.uint64(0xFF51AFD7ED558CCD))
        join = lambda old, new: np.concatenate([old[~cut], new])
        self.start, self.left, self.key = join(self.start, start), join(self.left, left), join(self.key, key)
        self.windows = join(self.windows, np.ones(len(start), np.int64))

    def take(self, rows: np.ndarray) -> None:
        self.start, self.windows, self.left, self.key = self.start[rows], self.windows[rows], self.left[rows], self.key[rows]

    @property
    def sizes(self) -> np.ndarray:
        return self.windows + self.length - 1

    def words(self) -> Iterator[np.ndarray]:
        """The bytes of every piece as numbers, eight at a time, zero beyond its end."""
        sizes = self.sizes
        for k in range(0, 2 * self.length - ANCHOR, 8):
            rest = np.clip(sizes - k, 0, 8).astype(np.uint64)
            mask = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest * np.uint64(8))) - np.uint64(1))
            yield self.eights[self.start + k] & mask

    def first_here(self, rank: np.ndarray) -> np.ndarray:
        """For every piece the one of smallest rank in this part of the input that has the very same bytes."""
        found = np.arange(len(self.start))
        if not len(found):
            return found
        mark = self.sizes.astype(np.uint64)
        for word in self.words():
            mark = _mixed(mark + word * np.uint64(0xC4CEB9FE1A85EC53))
        order = np.lexsort((rank, mark))
        new = np.concatenate(([True], mark[order][1:] != mark[order][:-1]))
        shared = ~new | np.append(~new[1:], False)
        order, first = order[shared], order[np.flatnonzero(new)[np.cumsum(new) - 1]][shared]
        same = self.sizes[order] == self.sizes[first]
        for word in self.words():
            same &= word[order] == word[first]
        found[order[same]] = first[same]
        return found


def _gather(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes, np.ndarray]]:
    """Up to AT_ONCE bytes of text: (doc_id, mark, place in the text) of every stretch, the bytes, the offsets.

    A text longer than that comes in stretches that share length - 1 bytes, so that each window is in one of them.
    """
    who, held, size = [], [], 0
    for batch in batches:
        for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch), strict=True):
            for at in range(0, max(1, len(text) - length + 1), AT_ONCE):
                part = text[at : at + AT_ONCE + length - 1]
                if len(part) < length:
                    continue
                if size and size + len(part) > AT_ONCE:
                    yield who, b"".join(held), np.cumsum([0, *map(len, held)])
                    who, held, size = [], [], 0
                who.append((doc_id, mark, at))
                held.append(part)
                size += len(part)
    if held:
        yield who, b"".join(held), np.cumsum([0, *map(len, held)])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of one document as one, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # Ends so far within a document: documents are set apart by an offset above all places.
    wide = np.int64(end.max() + 1)
    rank = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    reach = np.maximum.accumulate(end + rank * wide)
    new = np.concatenate(([True], start[1:] + rank[1:] * wide > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach[np.append(at[1:], len(doc)) - 1] - rank[at] * wide)


def _runs(piece: np.ndarray, doc: np.ndarray, place: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, doc, first place, last place) of places at most ``gap`` apart; what is found in a piece of at least that length covers a run without holes."""
    order = np.lexsort((place, doc, piece))
    piece, doc, place = piece[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > gap)
    at = np.flatnonzero(new)
    return piece[at], doc[at], place[at], place[np.append(at[1:], len(place)) - 1] if len(at) else place


_PACKED = "bucket int, covered boolean, ids binary, marks binary, docs binary, starts binary, keys binary, lefts binary, windows binary, bytes binary, run_pieces binary, run_docs binary, run_starts binary, run_ends binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_KINDS = [np.int64, np.int64, np.uint32, np.uint64, np.uint32, np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.uint64, np.uint64]
#: Columns that number the rows of another one.
_POINTS_TO = {2: 0, 8: 2, 9: 0}


class _Outbox:
    """Pieces by bucket, handed on as one compressed row a bucket."""

    def __init__(self):
        import zstandard

        self.pack, self.rows, self.size = zstandard.ZstdCompressor(level=1).compress, {}, 0

    def add(self, bucket: int, columns: list[np.ndarray]) -> None:
        self.rows.setdefault(bucket, []).append(columns)
        self.size += sum(c.nbytes for c in columns)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for bucket, parts in self.rows.items():
            whole = []
            for k in range(len(parts[0])):
                bases = np.cumsum([0, *(len(p[_POINTS_TO[k]]) for p in parts)]) if k in _POINTS_TO else None
                whole.append(np.concatenate([p[k] if bases is None else (p[k] + bases[i]).astype(np.uint32) for i, p in enumerate(parts)]))
            packed = [self.pack(c.tobytes()) for c in whole] + [None] * (len(_KINDS) - len(whole))
            yield pa.RecordBatch.from_arrays([pa.array([max(bucket, ~bucket)], pa.int32()), pa.array([bucket < 0]), *(pa.array([p], pa.binary()) for p in packed)], names=_NAMES)
        self.rows, self.size = {}, 0


def _dealt(batches: Iterator[pa.RecordBatch], length: int, buckets: int, part: int, slices: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = _Outbox()
    for who, text, offsets in _parts(batches, length):
        pieces = Pieces(np.frombuffer(text, np.uint8), offsets, length)
        pieces.split(frequent)
        pieces.take(np.flatnonzero((pieces.key >> np.uint64(48)) % np.uint64(slices) == np.uint64(part)))
        ids, marks, ats = (np.array([w[k] for w in who], np.int64) for k in range(3))
        doc = np.searchsorted(offsets, pieces.start, "right") - 1
        place = pieces.start - offsets[doc] + ats[doc]
        first = pieces.first_here(ids[doc])
        gone = ids[doc] > ids[doc[first]]
        if gone.any():
            d, s, e = _merged(doc[gone], place[gone], (place + pieces.sizes)[gone])
            used, local = np.unique(d, return_inverse=True)
            out.add(~int(offsets[-1] % buckets), [ids[used], marks[used], local, s.astype(np.uint64), e.astype(np.uint64)])
        stay = np.flatnonzero(first == np.arange(len(first)))
        more = np.flatnonzero(~gone & (first != np.arange(len(first))))
        bucket = (pieces.key[stay] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True]))) if len(order) else []
        dealt = np.zeros(len(first), np.int64)
        dealt[stay[order]] = np.arange(len(order))
        run_piece, run_doc, run_start, run_end = _runs(dealt[first[more]], doc[more], place[more], length)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = stay[order[a:b]]
            runs = slice(*np.searchsorted(run_piece, [a, b]))
            used, local = np.unique(np.concatenate([doc[rows], run_doc[runs]]), return_inverse=True)
            columns = [ids[used], marks[used], local[: len(rows)], place[rows].astype(np.uint64), (pieces.key[rows] >> np.uint64(32)).astype(np.uint32), pieces.left[rows].astype(np.uint8), pieces.windows[rows].astype(np.uint8)]
            columns += [_gather(pieces.data, pieces.start[rows], pieces.sizes[rows]), run_piece[runs] - a, local[len(rows) :]]
            out.add(int(bucket[order[a]]), [*columns, run_start[runs].astype(np.uint64), run_end[runs].astype(np.uint64)])
        if out.size > GATHERED:
            yield from out.flush()
    yield from out.flush()


def _names(rows: np.ndarray, primary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common length with the row before in that order) of fixed-width byte rows, primary key first."""
    width = rows.shape[1]
    words = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, k] for k in reversed(range(words.shape[1]))), primary))
    common = np.zeros(len(rows), np.int16)
    for a in range(1, len(rows), 1 << 18):
        b = min(len(rows), a + (1 << 18))
        differs = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common[1:][primary[order][1:] != primary[order][:-1]] = -1
    common[:1] = -1
    return order, common


def covered_windows(rank: np.ndarray, key: np.ndarray, left: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For every piece and window whether the window's bytes also stand in a piece of smaller rank."""
    context = length - ANCHOR
    sizes = windows.astype(np.int64) + length - 1
    offset = np.cumsum(sizes) - sizes
    rows = np.zeros((len(key), 2 * context + ANCHOR), np.uint8)
    column = np.arange(sizes.sum()) - np.repeat(offset, sizes) + np.repeat(context - left.astype(np.int64), sizes)
    rows[np.repeat(np.arange(len(key)), sizes), column] = data
    after, common_after = _names(rows[:, context:], key)
    before, common_before = _names(rows[:, :context][:, ::-1], key)
    found = np.zeros((len(key), context + 1), bool)
    for depth in range(context + 1):  # bytes of the window before its anchor
        at = np.flatnonzero((depth <= left) & (depth > left.astype(np.int64) - windows))
        if len(at) < 2:
            continue
        name = np.empty(len(key), np.uint64)
        name[before] = np.cumsum(common_before < depth)
        other = np.empty(len(key), np.uint64)
        other[after] = np.cumsum(common_after < length - depth)
        both = (name[at] << np.uint64(32)) | other[at]
        order = np.argsort(both)
        new = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        least = np.minimum.reduceat(rank[at][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = at[order[rank[at][order] > least]]
        found[hit, left[hit] - depth] = True
    return found


def _spans(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(ids.astype(np.int64)), pa.array(marks.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "start", "end"])


def _bucket_spans(rows: list[dict], length: int) -> pa.RecordBatch:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    parts = [[np.frombuffer(unpack(r[c]), k) for c, k in zip(_NAMES[2:], _KINDS, strict=True)] for r in rows]
    ids, run_ids = (np.concatenate([p[0][p[k]] for p in parts]) for k in (2, 9))
    marks, run_marks = (np.concatenate([p[1][p[k]] for p in parts]) for k in (2, 9))
    bases = np.cumsum([0, *(len(p[2]) for p in parts)])
    run_piece = np.concatenate([p[8] + bases[i] for i, p in enumerate(parts)])
    place, key, left, windows, data = (np.concatenate([p[k] for p in parts]) for k in range(3, 8))
    run_start, run_end = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (10, 11))
    # Anchors of a single document have nothing to find.
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    edges = np.flatnonzero(new)
    several = np.minimum.reduceat(ids[order], edges) != np.maximum.reduceat(ids[order], edges)
    kept = np.sort(order[several[np.cumsum(new) - 1]])
    sizes = windows.astype(np.int64) + length - 1
    data = _gather(data, (np.cumsum(sizes) - sizes)[kept], sizes[kept])
    ids, marks, place, key, left, windows = (x[kept] for x in (ids, marks, place, key, left, windows))
    number = np.full(bases[-1], -1)
    number[kept] = np.arange(len(kept))
    run_piece = number[run_piece]
    found = covered_windows(ids, key, left, windows, data, length)
    step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1]
    start = place[row].astype(np.int64) + first
    own = (ids[row], marks[row], start, start + (last - first) + length - 1)
    # The same for the other places of a piece.
    a, b = np.searchsorted(row, run_piece), np.searchsorted(row, run_piece, "right")
    run = np.repeat(np.arange(len(run_piece)), b - a)
    hit = np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    others = (run_ids[run], run_marks[run], run_start[run] + first[hit], run_end[run] + last[hit] + length - 1)
    return _spans(*(np.concatenate(pair) for pair in zip(own, others, strict=True)))


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["covered"]:
                ids, marks, docs, start, end = (np.frombuffer(unpack(row[c]), k) for c, k in zip(_NAMES[2:7], (np.int64, np.int64, np.uint32, np.uint64, np.uint64), strict=True))
                yield _spans(ids[docs], marks[docs], start, end)
                continue
            if held and held[0]["bucket"] != row["bucket"]:
                yield _bucket_spans(held, length)
                held = []
            held.append(row)
    if held:
        yield _bucket_spans(held, length)


def frequent_anchors(rows: DataFrame, length: int, buckets: int, text_bytes: int) -> np.ndarray:
    """Keys of anchors with many pieces, estimated from one document in LOOKED_AT: the heaviest, a bounded number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, offsets in _parts(batches, length):
            keys, n = np.unique(Pieces(np.frombuffer(text, np.uint8), offsets, length).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

    looked = rows.where(F.pmod(F.xxhash64("id", "mark"), F.lit(LOOKED_AT)) == 0)
    pieces_a_bucket = text_bytes * 2 // (length - ANCHOR + 2) // buckets
    least = max(FREQUENT, pieces_a_bucket // 4) // LOOKED_AT
    counts = looked.mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "key").limit(min(8 * buckets, MOST_FREQUENT)).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, mark, start, end): bytes covered by a string of ``length`` bytes that a document of smaller id holds too.

    Spans of one document may overlap. ``mark`` tells apart texts under one id.
    """
    rows = docs.select(_id().alias("id"), _mark().alias("mark"), "text").where(F.octet_length("text") >= length)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, -(-size // BUCKET_BYTES))
    frequent = frequent_anchors(rows, length, buckets, size)
    found = []
    for part in range(SLICES):
        dealt = rows.mapInArrow(lambda b, p=part: _dealt(b, length, buckets, p, SLICES, frequent), _PACKED)
        own = dealt.repartition(max(partitions, buckets // 4), "bucket").sortWithinPartitions("bucket", "covered")
        found.append(stored_table(own.mapInArrow(lambda b: _sorted_buckets(b, length), "id long, mark long, start long, end long"), f"spans-{part}"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _mark():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, removed (array of start, end, maximal and in order), kept (bytes).

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id,
    judged on the input. Texts shorter than that, nulls and empty ones lose nothing; copies within a document and under
    the same doc_id do not count; a null doc_id is larger than any other. Repeated rows repeat. Empty input gives no
    rows. Other columns are ignored.
    """
    spans = repeated_spans(docs, length).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    named = docs.select("doc_id", _id().alias("id"), _mark().alias("mark"), "text").join(spans.hint("merge"), ["id", "mark"], "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, kept, sizes = [], [], []
            for spans, text in zip(batch.column(1), byte_texts(batch), strict=True):
                sizes.append(len(text))
                if not spans.is_valid:
                    removed.append([])
                    kept.append(text)
                    continue
                pairs = spans.values
                start, end = (np.asarray(pairs.field(k)) for k in (0, 1))
                _, start, end = _merged(np.zeros(len(start), np.int64), start, end)
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)])
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return named.select("doc_id", "spans", "text").mapInArrow(task, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")

