"""How far the sources of a language diverge in their words, from exact joint tables of word counts.

The matrix has a row per kept term and an indicator column per (group, count), a group being a source within a language
and the count that of the term there. Its transpose times itself holds, for every two groups, how many terms have which
two counts: the joint table, which is all that any sum over terms of a function of both counts needs. The product is
taken in blocks of rows, dense in single precision, which is exact as no block has 2**24 rows; terms with like counts
share blocks, so that few columns occur in one. Counts of zero have no column: they follow from the diagonal, which
holds how many terms of a group have a count, and from the number of kept terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, stored_table

#: ASCII letters, lower-cased, and every character outside ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a kept term occurs in, at least.
DOCUMENTS = 3
#: Denominator of the shares.
SCALE = 1_000_000_000
#: Terms that are reported of a group.
RANKS = 200
#: Different terms that a task holds before it hands on its counts.
HELD = 200_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Columns that are multiplied at once.
TILE = 1_024


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that do not cut a term."""
    start = 0
    while len(text) - start > size:
        inside = TERM.match(text, start + size)
        end = inside.end() if inside else start + size
        yield text[start:end]
        start = end
    yield text[start:]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the documents with it, in partial sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (all_, in_) in held.items():
                terms, n = list(all_), len(all_)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                columns += [pa.array(all_.values(), pa.int64()), pa.array([in_[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch), strict=True):
                all_, in_ = held.setdefault((lang, source), (Counter(), Counter()))
                met: set[bytes] = set()
                for piece in pieces(text.lower()):
                    terms = TERM.findall(piece)
                    all_.update(terms)
                    met.update(terms)
                in_.update(met)
                if len(all_) > HELD:
                    yield from flush()
            if sum(len(a) for a, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(task, "lang string, source string, term string, n long, docs long")


def _block_rows(most: np.ndarray) -> np.ndarray:
    """Rows that share a block, by the largest count in a row: many where few counts are possible."""
    return np.clip(8_192 >> np.minimum(np.frexp(most)[1], 13), 16, 4_096)


def products(rows: DataFrame) -> DataFrame:
    """(g, a, s, b, n): terms with count a in group g and b in group s, g <= s; for g = s the terms with that count.

    ``rows`` is (lang, term, cells), the cells of a term being its groups and counts. The sums are those of blocks.
    """

    def block(row: np.ndarray, group: np.ndarray, count: np.ndarray) -> np.ndarray:
        columns, place = np.unique(np.stack([group, count], axis=1), axis=0, return_inverse=True)
        row = np.unique(row, return_inverse=True)[1]
        place, out = place.reshape(-1), []

        def tile(first: int) -> np.ndarray:
            one_hot = np.zeros((row.max() + 1, min(TILE, len(columns) - first)), np.float32)
            here = (place >= first) & (place < first + TILE)
            one_hot[row[here], place[here] - first] = 1
            return one_hot

        for i in range(0, len(columns), TILE):
            left = tile(i)
            for j in range(i, len(columns), TILE):
                joint = left.T @ (left if i == j else tile(j))
                x, y = np.nonzero(np.triu(joint) if i == j else joint)
                out.append(np.concatenate([columns[x + i], columns[y + j], joint[x, y][:, None].astype(np.int64)], axis=1))
        return np.concatenate(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0)
            sizes = np.diff(cells.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            group, count = (cells.flatten().field(i).to_numpy() for i in (0, 1))
            if not len(row):
                continue
            most = np.zeros(len(sizes), np.int64)
            np.maximum.at(most, row, count)
            # Rows in order of language and largest count; a block ends with either or when it has its rows.
            lang = batch.column(1).dictionary_encode().indices.to_numpy()
            order = np.lexsort((most, lang))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            edges, at = [], 0
            ends = np.flatnonzero(np.diff(lang[order], append=-1)) + 1
            while at < len(order):
                edges.append(at)
                at = min(at + int(_block_rows(most[order[at : at + 1]])[0]), int(ends[np.searchsorted(ends, at, "right")]))
            by_place = np.argsort(place[row], kind="stable")
            row, group, count = place[row][by_place], group[by_place], count[by_place]
            cuts = np.searchsorted(row, [*edges, len(order)])
            found = [block(row[a:b], group[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            cells_, place = np.unique(np.concatenate(found)[:, :4], axis=0, return_inverse=True)
            sums = np.zeros(len(cells_), np.int64)
            np.add.at(sums, place.reshape(-1), np.concatenate(found)[:, 4])
            yield pa.RecordBatch.from_arrays([*(pa.array(cells_[:, i]) for i in range(4)), pa.array(sums)], names=["g", "a", "s", "b", "n"])

    return rows.select("cells", "lang").mapInArrow(task, "g long, a long, s long, b long, n long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly; ``total`` is the group's count plus the number of kept terms."""
    return F.expr("1L") + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q), exactly."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language is from the others.

    Part ``pair`` names every other source of the language, part ``term`` the ``ranks`` terms by which the source most
    exceeds its language. Null lang, source or text are ''. Terms are runs of letters and of characters outside ASCII,
    A-Z lower-cased; a language keeps those in at least ``documents`` of its rows, repeated rows and copies counted as
    they come. A group without kept terms has pairs but no terms; a language without kept terms has pairs of value 0.
    Ties are in the order of the item's UTF-8 bytes. Empty input gives no rows; other columns are ignored.
    """
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = stored_table(named.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    sums = counted(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = sums.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("cells"))
    rows = stored_table(cells.where(F.col("docs") >= documents).select("lang", "term", "cells"), "rows")

    flat = rows.select("lang", "term", F.aggregate("cells", F.lit(0).cast("long"), lambda x, c: x + c["n"]).alias("all"), F.explode("cells").alias("cell"))
    flat = flat.select("lang", "term", "all", "cell.g", "cell.n")
    kept = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    group_sums = flat.groupBy("g").agg(F.sum("n").alias("n"))
    totals = groups.join(group_sums, "g", "left").join(kept, "lang", "left")
    totals = totals.select("g", "lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"))
    # Sums over languages only: a window here would gather all groups of a language.
    langs = totals.groupBy("lang").agg((F.sum(F.col("total") - F.col("terms")) + F.max("terms")).alias("lang_total"))
    totals = stored_table(totals.join(langs, "lang"), "totals")

    order = lambda: Window.partitionBy("g", "part").orderBy(F.desc("value"), "item")
    terms = flat.select("g", "term", "all", "n").join(totals.select("g", "total", "lang_total"), "g")
    p, q = share(F.col("n"), F.col("total")), share(F.col("all"), F.col("lang_total"))
    terms = terms.select("g", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("g", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= ranks)

    joint = products(rows).groupBy("g", "a", "s", "b").agg(F.sum("n").alias("n"))
    joint = stored_table(joint, "joint")
    pairs = pair_values(joint, totals).withColumn("part", F.lit("pair"))
    pairs = pairs.join(totals.select(F.col("g").alias("s"), F.col("source").alias("item")), "s").select("g", "part", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order()))
    found = pairs.unionByName(terms).join(totals.select("g", "lang", "source"), "g")
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def pair_values(joint: DataFrame, totals: DataFrame) -> DataFrame:
    """(g, s, value): the price of group g against every other group s of its language, summed over all kept terms.

    With f(a, b) the price of counts a and b, the sum over terms is that of f(a, b) - f(a, 0) - f(0, b) + f(0, 0) over
    the joint table, of f(a, 0) - f(0, 0) and of f(0, b) - f(0, 0) over the diagonals, and f(0, 0) for every term.
    """
    one = totals.select("g", "lang", F.col("terms"), F.col("total").alias("tg"))
    two = totals.select(F.col("g").alias("s"), F.col("lang").alias("lang_s"), F.col("total").alias("ts"))
    pairs = stored_table(one.join(two, (F.col("lang") == F.col("lang_s")) & (F.col("g") != F.col("s"))).select("g", "s", "terms", "tg", "ts"), "pairs")
    zero = F.lit(0)

    def f(a: Column, b: Column, tg: str = "tg", ts: str = "ts") -> Column:
        return price(share(a, F.col(tg)), share(b, F.col(ts)))

    off = joint.where("g < s")
    off = off.unionByName(off.select(F.col("s").alias("g"), F.col("b").alias("a"), F.col("g").alias("s"), F.col("a").alias("b"), "n"))
    off = off.join(one.select("g", "tg"), "g").join(two.select("s", "ts"), "s")
    a, b = F.col("a"), F.col("b")
    both = off.select("g", "s", (F.col("n") * (f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero))).alias("value"))
    diagonal = joint.where("g = s").select("g", "a", "n").join(pairs, "g")
    ahead = diagonal.select("g", "s", (F.col("n") * (f(a, zero) - f(zero, zero))).alias("value"))
    behind = diagonal.select(F.col("s").alias("g"), F.col("g").alias("s"), (F.col("n") * (f(zero, a, "ts", "tg") - f(zero, zero, "ts", "tg"))).alias("value"))
    none = pairs.select("g", "s", F.when(F.col("terms") == 0, 0).otherwise(F.col("terms") * f(zero, zero)).alias("value"))
    return both.unionByName(ahead).unionByName(behind).unionByName(none).groupBy("g", "s").agg(F.sum("value").alias("value"))
