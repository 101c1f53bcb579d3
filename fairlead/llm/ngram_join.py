"""Jaccard join of word n-gram sets by partitioning the universe of n-grams, and the components of its links.

Sizes are cut into bands so wide that two linked sets lie in the same band or in neighbouring ones. Within a band every
n-gram is hashed to one of H + 1 segments, H being the most n-grams by which linked sets of that band can differ. By the
pigeonhole principle two linked sets agree on all of at least one segment, so they meet in the bucket named by band,
segment and the subset there. Each set is entered in its own band and in the band below.

Allocation by cost: a segment costs the size of its bucket. A segment in a bucket above a bound is skipped, and the
skipped ones are paid for by segments compared within one deletion: if two sets agree on k skipped segments, each of
the others holds at least one difference, and any k of these must include one with exactly one difference or leave an
agreement elsewhere. As the order of segments is fixed, the first 2k segments always hold k that are not skipped.
Sets that agree with crowded buckets on more than half of their segments cannot pay; they stay in these buckets.
What counts is what is still to be told apart: the other buckets are worked through first, and a large bucket is crowded
only if more members than the bound then lie outside one component. So a group of copies pays nothing.

Candidates of a bucket are screened by parity sketches (the bits that differ are never more than the n-grams that do),
linked to a forest, not to all pairs, and verified on the n-grams themselves. Where a link of the forest proves false,
the bucket is worked through again without it and with more partners a round, until nothing is left to verify. A bucket
that has no candidate is done, as components only grow together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, stored_table
from fairlead.llm.graph import components

#: Members of a bucket above which its segment is skipped or, where that cannot be paid for, the bucket is divided.
BUCKET = 1_024
#: Texts that meet one other text in a task.
PARTNERS = 64
#: Bits of a parity sketch for each n-gram, and the fewest and most 64-bit words it has.
SKETCH_BITS, SKETCH_LEAST, SKETCH_MOST = 4, 8, 256
#: Bytes of a word up to which it is hashed beside the others of its text; longer words are hashed by xxHash.
WORD_BYTES = 256

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD, _OTHER_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # A-Z only; on the six ASCII white-space bytes


def shingles(parts: list[bytes], words: int) -> set:
    """The distinct n-grams; a shorter text is one as a whole."""
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return set(zip(*(parts[i:] for i in range(words)), strict=False))


def word_numbers(text: bytes) -> np.ndarray:
    """A 64-bit number for every word of a text: its bytes, eight at a time, all words at once."""
    lowered = text.lower()
    raw = np.frombuffer(lowered + bytes(9), np.uint8)
    inside = _INSIDE[raw]
    inside[len(lowered) :] = False
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turns = np.concatenate([[0], turns])
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    eight = np.ndarray((len(lowered) + 1,), "<u8", raw.data, strides=(1,))  # the eight bytes from any place on
    found = mix((eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD)
    longer, done = np.flatnonzero((lengths > 8) & (lengths <= WORD_BYTES)), 8
    while len(longer):
        more = eight[starts[longer] + done] & _FIRST_BYTES[np.minimum(lengths[longer] - done, 8)]
        found[longer] = mix(found[longer] * _OTHER_ODD + more)
        done += 8
        longer = longer[lengths[longer] > done]
    for i in np.flatnonzero(lengths > WORD_BYTES).tolist():
        import xxhash

        found[i] = xxhash.xxh64_intdigest(lowered[starts[i] : starts[i] + lengths[i]])
    return found


def hashes(each: np.ndarray, words: int) -> np.ndarray:
    """64-bit numbers of the distinct n-grams of at least ``words`` word numbers, in order."""
    n = len(each) - words + 1
    found = each[:n]
    for i in range(1, words):
        found = found * _ODD + each[i : i + n]
    found = np.sort(mix(found))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def sketch(numbers: np.ndarray) -> np.ndarray:
    """Parities of the n-grams by bit, in a power of two of 64-bit words that follows their number."""
    words = 1 << max(SKETCH_BITS * len(numbers) // 64, 1).bit_length()
    bits = 64 * min(max(words, SKETCH_LEAST), SKETCH_MOST)
    odd = np.bincount((mix(numbers) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(held: np.ndarray, words: int) -> np.ndarray:
    """The same sketch in fewer words."""
    while len(held) > words:
        held = held[: len(held) // 2] ^ held[len(held) // 2 :]
    return held


def differing(size: int | np.ndarray, percent: int):
    """How many n-grams at most are in one set only, if it shares at most ``size`` and the sets are linked."""
    return (100 - percent) * size // percent


def starts(percent: int) -> np.ndarray:
    """First size of every band; a set linked to a smaller one is in its band or the next."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, -(-found[-1] * 100 // percent)))
    return np.array(found)


@lru_cache(maxsize=256)
def _layout(band: int, largest: int, percent: int) -> tuple[int, np.ndarray, np.uint64]:
    """Number of segments of a band, a name for each, and the factor that deals n-grams to them."""
    count = int(differing(largest, percent)) + 1
    return count, mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 40)), mix(np.array([band + 1], np.uint64))[0] | np.uint64(1)


class Segments:
    """The subsets of one set in the segments of one band, as sums of their numbers."""

    def __init__(self, numbers: np.ndarray, band: int, first_sizes: np.ndarray, percent: int):
        self.numbers, self.band = numbers, band
        self.count, self.named, factor = _layout(band, int(first_sizes[band + 1]) - 1, percent)
        self.place = (((numbers * factor >> np.uint64(32)) * np.uint64(self.count)) >> np.uint64(32)).astype(np.int64)
        self.sums = np.zeros(self.count, np.uint64)
        np.add.at(self.sums, self.place, numbers)

    def whole(self) -> np.ndarray:
        """One key per segment and subset."""
        return mix(self.sums + self.named)

    def deleted(self, first: int) -> np.ndarray:
        """Keys of the first segments, of their subsets whole and with each one of the n-grams left out."""
        at = self.place < first
        tag = mix(self.named + np.uint64(1))
        return np.concatenate([mix(self.sums[:first] + tag[:first]), mix(self.sums[self.place[at]] - self.numbers[at] + tag[self.place[at]])])


def both_bands(numbers: np.ndarray, first_sizes: np.ndarray, percent: int) -> list[Segments]:
    own = int(np.searchsorted(first_sizes, len(numbers), "right")) - 1
    return [Segments(numbers, band, first_sizes, percent) for band in (own, own - 1) if band >= 0]


def _digest(parts: list[bytes]) -> bytes:
    import hashlib

    return hashlib.sha256(b" ".join(parts)).digest()


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def measured(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the words, key) of every row; the key is the first 8 bytes of the digest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in byte_texts(batch):
                parts = words_of(text)
                counts.append(len(shingles(parts, words)))
                digests.append(_digest(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(_keys(digests))], names=["doc_id", "n_shingles", "digest", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n_shingles long, digest binary, key long")


def sketched(texts: DataFrame, words: int) -> DataFrame:
    """Add the ``sketch`` of the n-grams to (class, key, n, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(hashes(word_numbers(t), words)).tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "sketch"])

    return texts.mapInArrow(task, "class long, key long, n long, text string, sketch binary")


def entries(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, key): the segments of every different text of ``words`` words or more, with its key.

    A text that a task has met before is not entered again, so copies enter once a task.
    """
    first_sizes = starts(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            sigs, keys = [], []
            for text in byte_texts(batch):
                each = word_numbers(text)
                if len(each) < words or (digest := _digest(words_of(text))) in met:
                    continue
                met.add(digest)
                for segments in both_bands(hashes(each, words), first_sizes, percent):
                    sigs.append(segments.whole())
                    keys.append(np.full(segments.count, _keys([digest])[0]))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    return docs.select("text").mapInArrow(task, "sig long, key long")


def chunks(rows: DataFrame, bucket: int) -> DataFrame:
    """(sig, part, keys): buckets of two or more different keys, in parts of at most ``bucket`` keys."""

    def cut(sig: int, keys: np.ndarray, part: int) -> Iterator[tuple[int, int, np.ndarray]]:
        for i in range(0, len(keys), bucket):
            yield sig, part + i // bucket, keys[i : i + bucket]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = key = np.zeros(0, np.int64)  # the open group, which the next batch may go on with
        part = 0  # and how many of its parts are out
        for batch in _with_end(batches):
            done = []
            if batch is not None:
                sig, key = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([key, batch.column(1).to_numpy()])
                order = np.lexsort((key, sig))
                sig, key = sig[order], key[order]
                new = np.ones(len(sig), bool)
                new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
                sig, key = sig[new], key[new]
            if not len(sig):
                continue
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), [len(sig)]])
            ended = len(edges) - (1 if batch is None else 2)
            sizes = np.diff(edges)[:ended]
            for g in np.flatnonzero((sizes > 1) | ((np.arange(ended) == 0) & (part > 0))):
                done += cut(int(sig[edges[g]]), key[edges[g] : edges[g + 1]], 0 if g else part)
            part = 0 if ended else part
            sig, key = sig[edges[ended] :], key[edges[ended] :]
            if (whole := max(len(sig) - 1, 0) // bucket) > 0:  # the last key stays, to tell its repetitions
                done += cut(int(sig[0]), key[: whole * bucket], part)
                sig, key, part = sig[whole * bucket :], key[whole * bucket :], part + whole
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.list_(pa.int64()))], names=["sig", "part", "keys"]
                )

    # Keys are put in order in the task: rows in the order of one number alone take Spark much less to sort.
    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(task, "sig long, part int, keys array<long>")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def paid(crowded: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, key) of what stands in for crowded buckets, from (key, sigs, text): the sigs of a text that are crowded."""
    first_sizes = starts(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, sigs, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch), strict=True):
                out = []
                for segments in both_bands(hashes(word_numbers(text), words), first_sizes, percent):
                    whole = segments.whole()
                    skipped = whole[np.isin(whole.view(np.int64), sigs)]
                    if 2 * len(skipped) > segments.count:
                        out.append(skipped)
                    if len(skipped):
                        out.append(segments.deleted(min(2 * len(skipped), segments.count)))
                if out:
                    found = np.concatenate(out).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), key))], names=["sig", "key"])

    return crowded.select("key", "sigs", "text").mapInArrow(task, "sig long, key long")


def forest(label: np.ndarray, side: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, false: set[tuple[int, int]], nodes: np.ndarray, percent: int, width: int = 1) -> list[tuple[int, int]]:
    """Pairs of rows to verify: of those that the sketches leave open between different labels, enough to go on.

    With a ``width`` of one they are a forest; else each row takes the ``width`` likeliest of every other label. Rows of
    side 0 meet rows of side 1; rows of side -1 meet each other. Pairs known to be false are left out.
    """
    label, found = np.unique(label, return_inverse=True)[1], []
    for x in range(len(label)):
        if side[x] == 1:
            continue
        meets = label != label[x]
        if side[x] < 0:
            meets[:x] = False
        else:
            meets &= side == 1
        y = np.flatnonzero(meets)
        if not len(y):
            continue
        both = sizes[x] + sizes[y]
        apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
        open_ = apart <= both - 2 * -(-percent * both // (100 + percent))
        if false:
            open_[open_] = [(min(nodes[x], n), max(nodes[x], n)) not in false for n in nodes[y[open_]].tolist()]
        y, apart = y[open_], apart[open_]
        if not len(y):
            continue
        order = np.lexsort((apart, label[y]))
        y, of = y[order], label[y[order]]
        number = np.arange(len(y)) - np.searchsorted(of, of)
        found += [(x, int(i)) for i in y[number < width]]
        if width == 1:
            label[np.isin(label, of)] = label[x]
    return found


def candidates(members: DataFrame, labels: DataFrame, texts: DataFrame, false: DataFrame, bucket: int, percent: int, width: int) -> DataFrame:
    """(bucket, a, b): pairs of (bucket, class) still to verify. Crowded buckets are divided; what is linked does not meet."""
    rows = members.join(labels, F.col("class") == F.col("node"), "left").select("bucket", "class", F.coalesce("label", "class").alias("label"))
    # The largest component is unknown without a count per label; that of the smallest member stands in for it.
    least = F.min(F.struct("class", "label"))
    whole = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), least["label"].alias("main"), F.count(F.lit(1)).alias("all"))
    whole = whole.where("low <> high").drop("low", "high")
    rows = rows.join(whole, "bucket").withColumn("rest", F.col("label") != F.col("main"))
    rest = rows.groupBy("bucket").agg(F.count(F.when(F.col("rest"), 1)).alias("others"))
    rows = stored_table(rows.join(rest, "bucket"), "open")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / bucket)).cast("int")
    others, mains = parts(F.col("others")), parts(F.col("all") - F.col("others"))
    small = F.col("all") <= bucket
    own = F.pmod(F.xxhash64("class"), F.when(F.col("rest"), others).otherwise(mains)).cast("int")
    meeting = lambda i, j, kind, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    zero, one, alone = F.lit(0), F.lit(1), F.lit(-1)
    among = F.transform(numbers(others), lambda q: meeting(F.least(q, own), F.greatest(q, own), 1, F.when(q == own, -1).when(own < q, 0).otherwise(1)))
    to_main = F.transform(numbers(mains), lambda q: meeting(own, q, 2, zero))
    to_rest = F.transform(numbers(others), lambda q: meeting(q, own, 2, one))
    meets: Column = F.when(small, F.array(meeting(zero, zero, 0, alone))).when(F.col("rest"), F.concat(among, to_main)).otherwise(to_rest)
    # A class is one row where its sketch and its false links come in, whatever the number of its buckets.
    places = rows.groupBy("class", "label").agg(F.collect_list(F.struct("bucket", meets.alias("meets"))).alias("places"))
    known = false.groupBy(F.col("a").alias("class")).agg(F.collect_set("b").alias("false"))
    rows = places.join(texts.select("class", "n", "sketch"), "class").join(known, "class", "left").withColumn("p", F.explode("places"))
    rows = rows.select("p.bucket", F.explode("p.meets").alias("m"), "class", "label", "n", "sketch", "false")
    rows = rows.select("bucket", "m.i", "m.j", "m.kind", "m.side", "class", "label", "n", "sketch", "false")

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        nodes = t["class"].to_numpy()
        apart = {(min(a, b), max(a, b)) for a, bs in zip(nodes.tolist(), t["false"].to_pylist(), strict=True) for b in bs or ()}
        held = [np.frombuffer(s, np.uint64) for s in t["sketch"].to_pylist()]
        least = min(map(len, held))
        sketches = np.stack([folded(s, least) for s in held])
        found = forest(t["label"].to_numpy(), t["side"].to_numpy(), t["n"].to_numpy(), sketches, apart, nodes, percent, width)
        if found:
            ends = np.sort(nodes[np.array(found)], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), t["bucket"][0].as_py())), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["bucket", "a", "b"])
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("bucket", "i", "j", "kind")):
            if (found := solve(group)) is not None:
                yield found

    keys = ("bucket", "i", "j", "kind")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(task, "bucket long, a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group of a sorted stream."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        values = np.stack([t[k].to_numpy().astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        same = held and [held[-1][k][-1].as_py() for k in keys] == values[0].tolist()
        for n, (a, b) in enumerate(pairwise(cuts)):
            if held and (n or not same):
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked): the n-grams of both texts compared. A text that has many partners travels once for each share."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
    pairs = stored_table(pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share")), "pairs")
    first = pairs.select("a", "share").distinct().join(texts, F.col("a") == F.col("class")).select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    other = pairs.join(texts, F.col("b") == F.col("class")).select("a", "share", "b", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: set = set()
        for batch in batches:
            a, b, linked = [], [], []
            for left, right, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), byte_texts(batch), strict=True):
                found = shingles(words_of(text), words)
                if right is None:
                    one = found
                    continue
                shared = len(one & found)
                a.append(left)
                b.append(right)
                linked.append(100 * shared >= percent * (len(one) + len(found) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    rows = first.union(other).repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
    return rows.mapInArrow(task, "a long, b long, linked boolean")


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int, bucket: int) -> DataFrame:
    """Links (a, b) between classes that keep together all that is linked."""
    met = stored_table(chunks(entries(docs, words, percent), bucket), "buckets")
    crowded = met.where("part = 1").select("sig")
    named = classes.select("class", "key", "digest", "least", "n_shingles")
    meant = met.select(F.explode("keys").alias("key")).distinct().join(named, "key")

    # One text per class that is in any bucket, that of its smallest id.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(words_of(t)) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["doc_id", "text", "hash"])

    hashed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, "doc_id long, text string, hash binary")
    texts = hashed.join(meant, (F.col("hash") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("least")))
    texts = texts.groupBy("class", "key").agg(F.first("n_shingles").alias("n"), F.first("text").alias("text"))
    texts = stored_table(sketched(texts, words), "texts")

    known = named.select("class", "key", "n_shingles")
    open_ = met.join(crowded, "sig", "left_anti").select("keys").distinct()
    members = _members(stored_table(open_.select(F.monotonically_increasing_id().alias("bucket"), "keys"), "open"), known)
    crowd = met.join(crowded, "sig", "left_semi").select("sig", _apart("sig").alias("bucket"), F.explode("keys").alias("key"))
    crowd = stored_table(crowd.join(known, "key"), "crowd")
    labels = classes.select(F.col("class").alias("node"), F.col("class").alias("label")).limit(0)
    false = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels, false = settled(stored_table(members, "members"), hubs(crowd, percent), labels, false, texts, words, percent, bucket)
    if not crowd.limit(1).count():
        return labels

    # What the other buckets and the hubs have left apart decides which of the crowded ones are worked through as they are.
    left = others(crowd, labels)
    kept = crowd.join(left.where(F.col("others").between(1, bucket)), "bucket", "left_semi").select("bucket", "class")
    hot = crowd.join(left.where(F.col("others") > bucket), "bucket", "left_semi").groupBy("key").agg(F.collect_list("sig").alias("sigs"))
    again = stored_table(chunks(paid(hot.join(texts, "key"), words, percent), bucket), "paid")
    full = F.size("keys") >= bucket
    small = again.where(~full & (F.col("part") == 0)).select("keys").distinct().select(F.monotonically_increasing_id().alias("bucket"), "keys")
    large = again.join(again.where(full).select("sig").distinct(), "sig", "left_semi").select(_apart("sig").alias("bucket"), F.explode("keys").alias("key"))
    large = stored_table(large.join(known, "key"), "large")
    members = _members(stored_table(small, "open"), known).union(large.select("bucket", "class")).union(kept)
    return settled(stored_table(members, "members"), hubs(large, percent), labels, false, texts, words, percent, bucket)[0]


def _apart(sig: str) -> Column:
    """The number of a bucket that keeps its own name, apart from those that are counted."""
    return F.bitwise_not(F.col(sig).bitwiseAND(F.lit(2**63 - 1)))


def _members(buckets: DataFrame, known: DataFrame) -> DataFrame:
    return buckets.select("bucket", F.explode("keys").alias("key")).join(known.select("class", "key"), "key").select("bucket", "class")


def hubs(crowd: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of crowded buckets meet its smallest one first, so that groups of copies need not meet among themselves."""
    hub = crowd.groupBy("bucket").agg(F.min(F.struct("class", "n_shingles")).alias("hub"))
    rows = crowd.join(hub, "bucket").where(F.col("hub.class") < F.col("class"))
    # Linked sets are of like size.
    sizes = F.col("hub.n_shingles"), F.col("n_shingles")
    rows = rows.where(100 * F.least(*sizes) >= percent * F.greatest(*sizes))
    return rows.select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct()


def others(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, others): how many members lie outside the component of the smallest one."""
    rows = crowd.join(labels, F.col("class") == F.col("node"), "left").select("bucket", "class", F.coalesce("label", "class").alias("label"))
    main = rows.groupBy("bucket").agg(F.min(F.struct("class", "label"))["label"].alias("main"))
    return rows.join(main, "bucket").groupBy("bucket").agg(F.count(F.when(F.col("label") != F.col("main"), 1)).alias("others"))


def settled(members: DataFrame, first: DataFrame, labels: DataFrame, false: DataFrame, texts: DataFrame, words: int, percent: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """The (node, label) and the false pairs when the pairs ``first`` and all buckets of (bucket, class) are worked through."""
    more, turn = first, 0
    while True:
        found = stored_table(candidates(members, labels, texts, false, bucket, percent, 8 ** max(turn - 1, 0)), "found")
        more = stored_table(found.select("a", "b").union(more).distinct(), "more")
        if not more.limit(1).count():
            return labels, false
        told = stored_table(verified(more, texts, words, percent), "told")
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(told.where("linked").select("a", "b"))
        false = stored_table(false.union(told.where("NOT linked").select("a", "b")), "false")
        labels = stored_table(components(links), "labels")
        # A bucket without candidates has none later either.
        members = stored_table(members.join(found.select("bucket").distinct(), "bucket", "left_semi"), "members")
        more, turn = first.limit(0), turn + 1


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included).

    A set holds the distinct n-grams of ``words`` lower-cased (A-Z) words; a text with fewer words is one n-gram, one
    without words, nulls included, has an empty set, is linked with nothing and names its own doc_id. Sets link when
    100 times their intersection is at least ``percent`` times their union. Texts with equal words are one class, told
    by SHA-256; links between classes are verified on the n-grams, not on hashes. Repeated rows repeat. A null doc_id
    names no component; a component of null ids only has a null component_id. Empty input gives no rows; other columns
    are ignored.
    """
    rows = stored_table(measured(docs, words), "measured")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.min("key").alias("key"))
    classes = stored_table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    labels = _links(docs, classes, words, percent, bucket)
    labelled = classes.select("class", "digest", "least").join(labels, F.col("class") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "class").alias("label"))
    labelled = stored_table(labelled, "labelled")
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("digest", "component_id")
    found = rows.join(named, "digest", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
