"""Periodic runs against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.llm import periodic_runs
from fairlead.llm.queries import op13_periodic_runs, with_planted_runs
from tests.llm.helpers import corpus, table


def brute(words) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(6, 4 * q):
                stretch = words[start : start + length]
                if not any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rest(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=5), st.integers(0, 10**6))
def test_runs_are_those_of_all_periods(texts, seed):
    rng = random.Random(seed)
    for _ in range(3):  # texts that are periodic in parts, nested too
        unit = rng.choices("abcd", k=rng.randint(1, 5)) * rng.randint(1, 6) + rng.choices("ab", k=rng.randint(0, 2))
        texts = [*texts, rng.choices("ab", k=rng.randint(0, 9)) + unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))] + rng.choices("ab", k=rng.randint(0, 9))]
    coded = [[w.encode() for w in t] for t in texts]
    for words, found in zip(texts, periodic_runs._together(coded), strict=True):
        assert [tuple(r) for r in found.tolist()] == brute(words)


def test_wavelet_tree_finds_neighbours():
    values = np.random.default_rng(3).permutation(77)
    tree = periodic_runs.WaveletTree(values)
    for low, high, at in np.random.default_rng(4).integers(0, 77, (300, 3)).tolist():
        low, high = min(low, high), max(low, high)
        inside = values[low:high].tolist()
        one = lambda x: np.array([x])
        assert tree.nearest(one(low), one(high), one(at), False)[0] == min([v for v in inside if v > at], default=-1)
        assert tree.nearest(one(low), one(high), one(at), True)[0] == max([v for v in inside if v < at], default=-1)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


ROWS = [(d, t, s) for d, t, s in corpus(9, 40)] + [
    (None, "a b " * 9, None), (None, None, None), (7_000_001, "x " * 50_000, None), (7_000_002, "é é é é é é", None), (7_000_002, "A a A a A a A a", None),
    (7_000_003, "one two three " * 4 + "end", None), (7_000_004, "", None),
]


def test_spans_and_rest(spark):
    found = periodic_runs.periodic_runs(table(spark, [r for r in ROWS if len(r[1] or "") < 20_000])).collect()
    expected = []
    for doc_id, text, _ in ROWS:
        if len(text or "") < 20_000:
            runs = brute(split(text))
            expected.append((doc_id or 0, runs, rest(split(text), runs)))
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in found) == sorted(expected)
    assert periodic_runs.periodic_runs(table(spark, [])).count() == 0


def test_query_on_given_and_planted_runs(spark, tmp_path):
    more = [(d, " ".join(random.Random(d).choices("abcdefghijklmnopqrst", k=40 + d % 300)), None) for d in range(20_000, 20_150)]
    rows = [r for r in ROWS if len(r[1] or "") < 20_000] + more
    table(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in op13_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = {}
    for doc_id, text, _ in rows:
        words = planted(doc_id, split(text))
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.setdefault(doc_id, []).append((doc_id, len(runs), *top, sha(lines), sha(rest(words, runs))))
    assert got.keys() == expected.keys()
    for doc_id, found in got.items():
        assert sorted(found, key=str) == sorted(expected[doc_id], key=str)
    assert sum(len(planted(d, split(t))) > 0 and planted(d, split(t)) != split(t) for d, t, _ in more) > 5
    assert with_planted_runs(table(spark, ROWS)).count() == len(ROWS)


def test_a_run_of_one_word_through_a_long_text():
    found = periodic_runs._together([[b"w"] * 300_000, [b"a", b"b"] * 100_000 + [b"a"]])
    assert found[0].tolist() == [[0, 300_000, 1]] and found[1].tolist() == [[0, 200_001, 2]]
