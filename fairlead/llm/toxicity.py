"""Toxicity scores of a factorization machine over hashed terms.

Terms are words and word beginnings, each at the levels "at least so many times", and the order of length of the text.
They are hashed; the machine has a weight and a short vector per kept term, and the product of two vectors is the weight
of their meeting in a text, which an additive model lacks. The machine is fitted on a bounded sample of labelled rows
(``SAMPLE``); terms are chosen by distributed counts over that sample. Every row is scored on its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import WORD, byte_texts, stored_table

#: Labelled rows that the fit may use, about; with fewer labels it uses all.
SAMPLE = 10_000
#: Kept terms, the least number of sampled texts that hold one, and the least two-sided score of its counts.
TERMS = 2_048
LEAST_TEXTS = 5
LEAST_Z = 4.0
#: Hash space of the terms, length of a term's vector.
SPACE = 1 << 24
FACTORS = 8
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3, 5)
_WORDS = re.compile(WORD)


def _hash(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) % SPACE


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of one word, before levels."""
    return [_hash(b"w", word)] + [_hash(b"b", word[:n]) for n in BEGINNINGS if len(word) >= n]


def leveled(term: int, level: int) -> int:
    return term * len(LEVELS) + level


def length_term(words: int) -> int:
    return leveled(_hash(b"n", str(words.bit_length()).encode()), 0)


def terms(text: bytes) -> list[int]:
    """All hashed terms of a text with their levels, distinct and sorted."""
    words = _WORDS.findall(text.lower())
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for term in word_terms(word):
            counts[term] += n
    found = {leveled(t, k) for t, n in counts.items() for k, least in enumerate(LEVELS) if n >= least}
    return sorted(found | {length_term(len(words))})


@dataclass
class Machine:
    """P(toxic) = logistic(bias + sum of weights + sum over pairs of the products of their vectors)."""

    slots: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: list[int]) -> float:
        if not found:
            return 1 / (1 + math.exp(-self.bias))
        v = self.vectors[found]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.weights[found].sum()) + pairs
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def scorer(self, remembered: int = 500_000):
        """A function from text to score that remembers which kept terms a word has."""
        by_term: dict[int, list[tuple[int, int]]] = {}
        for code, slot in self.slots.items():
            by_term.setdefault(code // len(LEVELS), []).append((LEVELS[code % len(LEVELS)], slot))
        known: dict[bytes, tuple[int, ...]] = {}

        def of(text: bytes) -> float:
            words = _WORDS.findall(text.lower())
            counts: dict[int, int] = {}
            for word, n in Counter(words).items():
                own = known.get(word)
                if own is None:
                    if len(known) >= remembered:
                        known.clear()
                    own = known[word] = tuple(t for t in word_terms(word) if t in by_term)
                for term in own:
                    counts[term] = counts.get(term, 0) + n
            found = [slot for t, n in counts.items() for least, slot in by_term[t] if n >= least]
            length = self.slots.get(length_term(len(words)))
            return self.score(sorted(set(found) | ({length} if length is not None else set())))

        return of


def fit(rows: list[list[int]], toxic: np.ndarray, size: int, epochs: int = 200, rate: float = 0.03, decay: float = 2e-4, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by Adam on the mean logistic loss; ``rows`` are lists of slots below ``size``."""
    n = len(rows)
    base = math.log((toxic.sum() + 0.5) / (n - toxic.sum() + 0.5)) if n else -2.0
    weights, vectors = np.zeros(size, np.float32), np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    if not n or not size or toxic.min() == toxic.max():
        return base, weights, vectors * 0
    x = np.zeros((n, size), np.float32)
    for i, row in enumerate(rows):
        x[i, row] = 1
    params = [np.array([base], np.float32), weights, vectors]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y = toxic.astype(np.float32)
    for step in range(1, epochs + 1):
        sums = x @ params[2]
        z = params[0] + x @ params[1] + 0.5 * ((sums**2).sum(axis=1) - x @ (params[2] ** 2).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        per_term = x.T @ error
        grads = [error.sum(keepdims=True), per_term + decay * params[1], x.T @ (error[:, None] * sums) - per_term[:, None] * params[2] + decay * params[2]]
        for k, g in enumerate(grads):
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def held_out() -> Column:
    """Rows that the fit may not look at: a quarter by a checksum of the id. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array((terms(t) for t in byte_texts(batch)), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "toxic", "terms"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit a machine on labelled rows that are not held out; every text counts once."""
    allowed = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, allowed.count()))
    # A digest of the id picks the rows, so their number keeps near `sample` whatever the labels hold.
    chosen = allowed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * sample)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(_termed, "doc_id long, toxic int, terms array<int>")
    # Equal texts that are labelled differently count as toxic, whatever the order of the rows.
    rows = stored_table(rows, "terms").groupBy("terms").agg(F.max("toxic").alias("toxic"))
    rows = stored_table(rows, "distinct-terms")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = whole["n"], whole["bad"]
    if not 0 < bad < n:
        bias, weights, vectors = fit([[]] * n, np.full(n, float(bool(bad))), 0)
        return Machine({}, bias, weights, vectors)
    counted = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("in_bad"))
    p = F.col("all") / n
    z = (F.col("in_bad") / bad - (F.col("all") - F.col("in_bad")) / (n - bad)) / F.sqrt(p * (1 - p) * (1 / bad + 1 / (n - bad)) + 1e-12)
    kept = counted.where(F.col("all") >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS)
    slots = {r["term"]: i for i, r in enumerate(kept.select("term").collect())}
    chosen_terms = F.array_intersect("terms", F.array(*[F.lit(t) for t in slots])) if slots else F.array().cast("array<int>")
    sampled = rows.select("toxic", chosen_terms.alias("own")).collect()
    ordered = sorted((sorted(slots[t] for t in r["own"]), r["toxic"]) for r in sampled)
    bias, weights, vectors = fit([own for own, _ in ordered], np.array([bad for _, bad in ordered], float), len(slots))
    return Machine(slots, bias, weights, vectors)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row's whole text. Null is the empty text, which has a score as well."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in byte_texts(batch)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Learn and score: doc_id, held_out, score (0 to 1), predicted (1 from ``least`` on), one row per input row.

    Of the labels, null ids and verdicts are left out and repeated ids count once, toxic if any says so. Without
    labels of both kinds every text gets the same score. Empty input gives no rows. Other columns are ignored.
    """
    rows = scored(docs, learn(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns."""
    machine, at = learn(docs, labels), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([score(t.as_py() or b"") < least for t in texts], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
