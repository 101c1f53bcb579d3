"""The divergence of sources against a direct sum over all terms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from fairlead.llm import source_audit

SCHEMA = "g long, lang string, term string, n long, source string, text string, part string, doc_id long"


def table(spark, rows):
    return spark.createDataFrame([(1, lang, "t", 5, source, text, "p", 3) for lang, source, text in rows], SCHEMA)


def brute(rows, least=3, ranks=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    for g in groups:
        count[g] = Counter({t: n for t, n in count[g].items() if t in set(kept.get(g[0], ()))})
    whole = defaultdict(Counter)
    for lang, source in groups:
        whole[lang].update(count[lang, source])

    def shares(lang, c):
        return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept.get(lang, ())}

    out, f = [], lambda p, q: (p - q) ** 2 // q
    p = {g: shares(g[0], count[g]) for g in groups}
    for lang, source in groups:
        mine, all_ = p[lang, source], shares(lang, whole[lang])
        pairs = [(sum(f(mine[t], other[t]) for t in mine), s) for (x, s), other in p.items() if x == lang and s != source]
        terms = [(f(mine[t], all_[t]), t) for t in mine if count[lang, source][t] and mine[t] > all_[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def rows(seed=2):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choices("abcABCéß", k=rng.randint(1, 5))) for _ in range(120)] + ["中文", "x1y", "nul\x00l"]
    out = [(None, None, None), ("en", "empty", None), ("en", "blank", "1 2 3"), ("xx", "only", "rare words"), ("", "s", "a-b"), ("q", None, ""), ("q", "z", "")]
    for _ in range(150):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["a", "b", "c", "é", "Z", None])
        out.append((lang, source, " ".join(rng.choices(words[: 40 if source == "a" else None], k=rng.randint(0, 90)))))
    return out + [out[-1]] * 3 + [("en", "b", "the " * 3000)] * 3


@pytest.mark.parametrize("tile", [1024, 7])
def test_same_as_direct_sum(spark, monkeypatch, tile):
    monkeypatch.setattr(source_audit, "TILE", tile)
    given = rows()
    found = source_audit.audit(table(spark, given).repartition(4)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == brute(given)


def test_few_ranks_and_no_rows(spark):
    given = rows(8)
    found = source_audit.audit(table(spark, given), documents=2, ranks=3).collect()
    assert sorted(map(tuple, found)) == brute(given, 2, 3)
    assert source_audit.audit(table(spark, [])).count() == 0


def test_pieces_cut_no_term():
    text = b"abc defgh" * 50 + b" " + b"x" * 100 + b" y"
    for size in (1, 5, 64, 1000):
        assert [t for p in source_audit.pieces(text, size) for t in source_audit.TERM.findall(p)] == source_audit.TERM.findall(text)
