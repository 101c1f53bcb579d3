"""Approximate nearest neighbours by collision counting over sorted single projections.

The vectors are dealt into blocks. In the task that searches a block, every random projection has its projected values
in sorted order. For a query a window around its own projected value opens in every array; virtual rehashing widens it
round by round, and only what a round adds is counted. A vector that lies in the windows of enough projections is a
candidate; once there are enough of them, or the windows hold the whole block, the candidates are verified by their exact
distance. How many are enough grows with the square root of all vectors, so the share that is verified falls as they
become more. The projections are random and fixed, so nothing is fitted, and every row is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import stored_table

PROJECTIONS = 256
#: Share of the projections in whose windows a candidate must lie.
COLLISIONS = 0.62
#: Candidates that a query asks for over all blocks, in square roots of the number of vectors.
ASKED = 5.0
#: First half width of the windows in standard deviations of a projection, and its growth by virtual rehashing.
FIRST_WIDTH = 1.0
GROWTH = 1.04
#: Vectors of a block on average, queries of a bundle.
BLOCK = 4_096
BUNDLE = 256


@lru_cache(maxsize=8)
def directions(dimensions: int, count: int = PROJECTIONS) -> np.ndarray:
    """Random unit directions, the same in every run and task."""
    drawn = np.random.default_rng(1_000 + dimensions).normal(size=(dimensions, count))
    return drawn / np.linalg.norm(drawn, axis=0)


class Block:
    """Vectors of one block with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        projected = (vectors.astype(np.float32) @ directions(vectors.shape[1]).astype(np.float32)).T
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(projected, axis=1)
        values = np.take_along_axis(projected, self.order, axis=1).astype(np.float64)
        self.spread = float(values.std(axis=1).mean()) if values.size else 0.0
        # One array for all projections: each has a range of its own, so that one search finds all window edges.
        self.reach = float(np.abs(values).max(initial=1.0)) + 0.25
        self.apart = 2.0 * self.reach + 0.25
        self.line = (values + self.apart * np.arange(len(values))[:, None]).ravel()

    def edges(self, projected: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, within each projection, of the window around the projected values."""
        n, m = len(self.ids), len(projected)
        own, firsts = self.apart * np.arange(m), n * np.arange(m)
        low = np.searchsorted(self.line, np.clip(projected - half, -self.reach, self.reach) + own, "left")
        high = np.searchsorted(self.line, np.clip(projected + half, -self.reach, self.reach) + own, "right")
        return np.clip(low - firsts, 0, n), np.clip(high - firsts, 0, n)

    def candidates(self, projected: np.ndarray, wanted: int) -> np.ndarray:
        """Rows in the windows of enough projections, at least ``wanted`` if the block holds as many."""
        n, m = len(self.ids), len(projected)
        if n <= wanted:
            return np.arange(n)
        least, half = max(1, int(m * COLLISIONS)), max(1e-6, FIRST_WIDTH * self.spread)

        def met(edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            """How often every row is in the given stretches of the sorted arrays."""
            parts = [rows[a:b] for first, last in edges for rows, a, b in zip(self.order, first.tolist(), last.tolist(), strict=True) if a < b]
            return np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)

        # First windows hold more than half of the rows, so those that lie outside are counted.
        low, high = self.edges(projected, half)
        counts = m - met([(np.zeros(m, np.int64), low), (high, np.full(m, n))])
        while True:
            found = np.flatnonzero(counts >= least)
            if len(found) >= wanted or (high - low).sum() == n * m:
                return found
            half *= GROWTH
            below, above = self.edges(projected, half)
            counts += met([(below, low), (high, above)])
            low, high = below, above

    def nearest(self, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(projected, k + 1 + wanted)
        rows = rows[self.ids[rows] != query_id]
        apart = np.sqrt(((self.vectors[rows].astype(np.float64) - query.astype(np.float64)) ** 2).sum(axis=1))
        first = np.lexsort((self.ids[rows], apart))[:k]
        return self.ids[rows[first]], apart[first]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector without nulls, finite and not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & some)
    return rows.select(F.col("vec_id").cast("long"), v.alias("v"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _indexed(rows: pa.Table) -> pa.Table:
    ids, v = rows["vec_id"].to_numpy(), _vectors(rows["v"])
    order = np.argsort(ids, kind="stable")
    head = [rows["block"][0].as_py(), rows["size"][0].as_py(), len(ids), v.dtype.str]
    payload = [ids[order].tobytes(), np.ascontiguousarray(v[order]).tobytes()]
    return pa.table([pa.array([x]) for x in [*head, *payload]], names=_INDEX.names).cast(_INDEX)


_INDEX = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of (vec_id, v), stored; blocks hold vectors of one length and have a size that does not grow.

    The sorted projections, several times as large as the vectors, are made where a block is searched.
    """
    blocks = max(1, -(-rows.count() // block))
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    dealt = rows.withColumn("size", F.size("v")).withColumn("block", spread)
    made = dealt.groupBy("block", "size").applyInArrow(_indexed, "block long, size int, n long, kind string, ids binary, vectors binary")
    return stored_table(made, "vector-blocks")


def _bundled(rows: pa.Table) -> pa.Table:
    v = np.ascontiguousarray(_vectors(rows["v"]))
    head = [rows["size"][0].as_py(), rows["vec_id"].to_numpy().tobytes(), v.tobytes()]
    return pa.table([pa.array([head[0]], pa.int32()), pa.array([head[1]], pa.binary()), pa.array([head[2]], pa.binary())], names=["size", "query_ids", "queries"])


def search(rows: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest found of every query, with their exact Euclidean distances."""
    bundles = max(1, -(-queries.count() // BUNDLE))
    whole = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    asked = queries.withColumn("size", F.size("v")).withColumn("bundle", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(bundles)))
    asked = stored_table(asked.groupBy("bundle", "size").applyInArrow(_bundled, "size int, query_ids binary, queries binary"), "query-bundles")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, n, kind = row["size"], row["n"], np.dtype(row["kind"])
                own = Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(n, size))
                wanted = int(np.ceil(ASKED * whole**0.5 * n / whole))  # a block's share of what a query asks for
                ids, v = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], kind).reshape(-1, size)
                projected = v.astype(np.float64) @ directions(size)
                for i, q in enumerate(ids):
                    near, score = own.nearest(q, v[i], projected[i], k, wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    # Every bundle of the stated queries meets every block of the rows, by an equi-join on the block.
    places = blocks.select("block", "size")
    met = asked.join(places, "size").join(blocks, ["block", "size"])
    found = met.mapInArrow(task, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose id is a multiple of ``every``, the nearest others found.

    Rows take no part if their id or vector is null or the vector is empty, zero or holds null or non-finite
    components. Only vectors of the query's length are its candidates. Ties in distance go to the smaller id. Rows that
    repeat an id and vector are one row; an id with several vectors is a query with each of them, and one id is listed
    at most once per vector. Empty input gives no rows. Other columns are ignored.
    """
    rows = stored_table(usable(vectors, vector).distinct(), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    found = search(rows, index(rows), queries, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
