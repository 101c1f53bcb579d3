"""The n-gram join and the components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fairlead.llm import graph, ngram_join
from tests.llm.helpers import corpus, table


def variants(seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    """Groups of texts at every distance from each other, chains of versions, and texts around shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    out, passage = [], [word() for _ in range(60)]
    for n in (3, 4, 5, 9, 12, 30, 80, 200):
        text = [word() for _ in range(n)]
        for _ in range(12):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(1 + n // 60):
                text[rng.randrange(n)] = word()
    for _ in range(25):
        out.append(" ".join(passage + [word() for _ in range(rng.randint(5, 60))]))
        out.append(" ".join(passage[:40]) + "\t" + " ".join(word() for _ in range(rng.randint(5, 9))))
    rng.shuffle(out)
    return [(7 * i + 2, t, None) for i, t in enumerate(out)]


def brute(rows, words=4, percent=85):
    sets = []
    for _, text, _ in rows:
        parts = (text or "").encode().lower().split()
        grams = {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}
        sets.append(grams or ({tuple(parts)} if parts else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return sorted(((d or 0), len(s), least[root(i)] if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("bucket", "percent"), [(1024, 85), (2, 85), (4, 60)])
def test_same_components_as_brute_force(spark, bucket, percent):
    rows = corpus(5, 20) + [(d + 100_000, t, s) for d, t, s in variants()]
    assert found(ngram_join.ngram_join(table(spark, rows).repartition(3), percent=percent, bucket=bucket)) == brute(rows, percent=percent)


def test_nulls_repeated_rows_and_no_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, long, None), (None, long, None), (4, long.upper(), None), (4, long.upper(), None), (9, None, None), (9, "", None), (None, " ", None), (3, "a b", None), (2, "A  b", None), (None, "q r s t u", None), (5, "b a", None)]
    assert found(ngram_join.ngram_join(table(spark, rows), bucket=2)) == brute(rows)
    assert ngram_join.ngram_join(table(spark, [])).count() == 0


def test_segments_of_linked_sets_meet():
    """With everything crowded, what is paid must still let any two linked sets meet."""
    rng, sizes = np.random.default_rng(1), ngram_join.starts(85)
    for n in (6, 7, 20, 60, 300):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a[: len(a) - int(rng.integers(0, 15 * len(a) // 100 + 1))]
            one, two = (ngram_join.both_bands(np.sort(x), sizes, 85) for x in (a, b))
            assert set(np.concatenate([s.whole() for s in one]).tolist()) & set(np.concatenate([s.whole() for s in two]).tolist())
            for s in one:
                for t in (t for t in two if t.band == s.band):
                    shared = np.count_nonzero(s.whole() == t.whole())
                    if 0 < shared <= s.count // 2:
                        assert set(s.deleted(2 * shared).tolist()) & set(t.deleted(2 * shared).tolist())


def test_long_shuffled_paths_settle(spark):
    order = np.random.default_rng(7).permutation(5000).tolist()
    links = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)) + [(9001, 9000), (9002, 9000), (9005, 9005), (None, 4)], "a long, b long")
    rows = graph.components(links).collect()
    assert {r.node: r.label for r in rows} == {n: 0 for n in range(5000)} | {9000: 9000, 9001: 9000, 9002: 9000, 9005: 9005}


def test_classes_meet_their_sketch_before_their_buckets(spark):
    """One row per class in these joins, though every class is in ten buckets."""
    members = spark.createDataFrame([(b, c) for b in range(10) for c in range(6)], "bucket long, class long")
    labels = spark.createDataFrame([(c, c) for c in range(6)], "node long, label long")
    texts = spark.createDataFrame([(c, 5, bytes(64)) for c in range(6)], "class long, n long, sketch binary")
    false = spark.createDataFrame([(0, 1)], "a long, b long")
    pairs = ngram_join.candidates(members, labels, texts, false, 4, 85, 64)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Join LeftOuter")].count("Generate explode") == 2
    assert pairs.count() > 0


def near_copies(n: int, words: int = 120, seed: int = 5) -> list[tuple[int, str, None]]:
    """Copies of a text with one word changed each, and as many texts that share four fifths of it, which is less than a link takes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    text, out = [word() for _ in range(words)], []
    for i in range(n):
        changed = list(text)
        changed[rng.randrange(words)] = word()
        out += [(2 * i, " ".join(changed), None), (2 * i + 1, " ".join(text[: words * 4 // 5] + [word() for _ in range(words // 5)]), None)]
    return out


def test_a_large_group_of_near_copies_pays_nothing(spark, monkeypatch):
    """Its buckets are above the bound, but few of their members are still apart once the other buckets are done."""
    paying, paid = [], ngram_join.paid
    monkeypatch.setattr(ngram_join, "paid", lambda rows, *rest: (paying.append(rows.count()), paid(rows, *rest))[1])
    rows = [r for r in near_copies(40) if r[0] % 2 == 0]
    assert found(ngram_join.ngram_join(table(spark, rows), bucket=16)) == brute(rows)
    assert sum(paying) == 0


def test_buckets_without_candidates_leave_the_next_rounds(spark, monkeypatch):
    met, candidates = [], ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda members, *rest: (met.append(members.count()), candidates(members, *rest))[1])
    rows = [r for r in near_copies(40) if r[0] % 2 or r[0] < 12]
    assert found(ngram_join.ngram_join(table(spark, rows), bucket=1024)) == brute(rows)
    assert met[0] > 100 and met[-1] < met[0] // 2
