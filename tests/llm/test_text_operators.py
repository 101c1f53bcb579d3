"""The text operators against brute force, on awkward inputs and without any."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.llm import ann, bpe, exact_dedup, graph, license_scan, line_dedup, mixing, simhash, suffix_dedup, token_count
from fairlead.llm.queries import older_half, rank_file
from tests.llm.helpers import corpus, table


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def utf8(text):
    return (text or "").encode()


def sha(data):
    return hashlib.sha256(data).hexdigest()


# -- 1: license scan -------------------------------------------------------------------------------------------------

LICENSED = [
    (1, "Released under the MIT License.\nUnder the  MIT-license", None),
    (2, "apache license, version 2.0 CC BY-NC 4", None),
    (3, "This work is licensed " + "word " * 3 + "under the GNU General Public License, version 3", None),
    (4, "filler " * 400 + "This work is licensed under the GNU General Public License, version 3 " + "filler " * 400, None),
    (5, "under the mit licenses", None),
    (6, None, None),
    (7, "", None),
    (None, "licensed under the apache license", None),
    (7, "under the mit license under the mit license", None),
]


def test_license_blocks_are_those_of_brute_force(spark):
    found = license_scan.license_scan(table(spark, LICENSED)).collect()
    known = license_scan.Templates.of(license_scan.TEMPLATES)
    expected = []
    for _, text, _ in LICENSED:
        blocks = license_scan.text_blocks(utf8(text), known.longest)
        expected.append(sorted((a, t) for a, words in blocks for t, s in enumerate(known.sets) if len(s & set(words)) >= 0.8 * len(s)))
    assert sorted(sorted((b.first, b.template) for b in r.blocks) for r in found) == sorted(expected)
    by_id = {r.doc_id: r for r in found if r.doc_id != 7}
    assert [(p.first, p.label) for p in by_id[1].places] == [(1, "mit"), (5, "mit")]
    assert {p.label for p in by_id[2].places} == {"apache-2", "cc-by-nc"}
    assert {b.label for b in by_id[3].blocks} == {b.label for b in by_id[4].blocks} == {"gpl-3"}
    assert not by_id[5].places and by_id[6].n_words == 0
    assert {b.label for b in by_id[None].blocks} >= {"apache-2"} or by_id[None].blocks == []


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
"""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""
APACHE_GRANT = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


@pytest.mark.parametrize("before", [0, 1, 9, 20, 33, 100])
def test_wrapped_notices_are_found(spark, before):
    lead = "filler words\n" * before
    hashed = "".join("# " + line + "\n" for line in MIT_GRANT.splitlines())
    one_line = " ".join(BSD_GRANT.split())
    texts = [lead + MIT_GRANT + lead, lead + BSD_GRANT, lead + APACHE_GRANT, lead + hashed, lead + one_line, lead + one_line + "\n" + BSD_GRANT, "mit\n" + lead * 2 + "under the license"]
    found = {r.doc_id: r for r in license_scan.license_scan(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, label in enumerate(["mit", "bsd", "apache-2", "mit", "bsd", "bsd"]):
        assert {b.label for b in found[i].blocks} == {label} and max(b.containment for b in found[i].blocks) == 1.0, i
    assert len(found[4].blocks) == 1  # a notice in one line is not told again
    assert len(found[5].blocks) > 1  # but one beside it is
    assert [len(found[6].blocks) > 0] == [before <= 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]), max_size=14), st.integers(0, 9))
def test_join_filters_lose_nothing(block, seed):
    known = license_scan.Templates.of([("x", "a b c d e"), ("y", "c d"), ("z", "f"), ("w", "a b c d e f g")])
    frequency = {bytes([c]): (c * 7 + seed * 3) % 5 for c in b"abcdefg"}
    for threshold in (0.3, 0.6, 0.8, 1.0):
        join = license_scan.Join(known, frequency, threshold)
        expected = [t for t, s in enumerate(known.sets) if len(s & set(block)) >= max(1, math.ceil(threshold * len(s) - 1e-9))]
        assert [t for t, _ in join.matches(block)] == expected


# -- 2: line dedup ---------------------------------------------------------------------------------------------------


def test_line_dedup_keeps_the_earliest(docs, rows):
    seen, expected = {}, {}
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        spans, units = [], 0
        for start, end, unit in line_dedup.lines(utf8(text)):
            units += 1
            if unit in seen:
                spans.append((start, end))
            seen.setdefault(unit, (doc_id, start))
        spans = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
        expected[doc_id] = (units, spans, line_dedup.without(utf8(text), spans))
    found = {r.doc_id: (r.n_units, [(s.start, s.end) for s in r.removed or []], bytes(r.kept)) for r in line_dedup.dedup_lines(docs).collect()}
    assert found == expected


def test_line_dedup_awkward_ids(spark, none):
    text = "Same  LINE of a good eight words here\nshort"
    given_ = table(spark, [(None, "same line of a good eight words here", None), (5, text, None), (5, text, None), (4, None, None), (6, "short", None)])
    found = sorted((r.doc_id or 0, r.n_units, len(r.removed or []), bytes(r.kept)) for r in line_dedup.dedup_lines(given_).collect())
    assert found == [(0, 1, 1, b""), (4, 0, 0, b""), (5, 2, 0, text.encode()), (5, 2, 0, text.encode()), (6, 1, 1, b"")]
    assert line_dedup.dedup_lines(none).count() == 0


def test_whole_lines_of_any_length_go(spark):
    rows_ = [(1, "a\n\nShort one.\n短い行。別の文もここに並んでいて十分に長い。\nHe said no. He left.\n", None),
             (2, "b\nshort   ONE.\n短い行。違う文がここに並んでいて十分に長い。\nHe left. He said no.\na", None),
             (3, "前置き。別の文もここに並んでいて十分に長い。He said no. He left.", None)]
    found = {r.doc_id: bytes(r.kept).decode() for r in line_dedup.dedup_lines(table(spark, rows_)).collect()}
    assert found[1] == rows_[0][1]
    assert found[2] == "b\n短い行。違う文がここに並んでいて十分に長い。\nHe left. He said no.\n"  # short sentences of other lines stay
    assert found[3] == "前置き。He said no. He left."
    assert line_dedup.outermost([(0, 9), (0, 4), (5, 9), (9, 12), (10, 12)]) == [(0, 9), (9, 12)]


def test_a_passage_inside_a_line_is_found(spark):
    passage = "The first of its sentences has a start of its own. " + "And each of the next ones is the same in all. " * 2
    passage += "It ends here with as many words as any other. "
    given_ = table(spark, [(1, "An opening that is in this one only " + passage + "More.", None), (2, "Other words stand at this place " + passage + "Less.", None)])
    found = {r.doc_id: bytes(r.kept) for r in line_dedup.dedup_lines(given_).collect()}
    assert b"And each" not in found[2] and b"It ends" not in found[2] and found[2].startswith(b"Other words") and found[2].endswith(b"Less.")
    assert found[1].count(b"And each") == 1 and b"It ends" in found[1]


# -- 4: byte-level BPE -----------------------------------------------------------------------------------------------


def test_bpe_is_that_of_the_library(docs, rows):
    path, pattern = rank_file()
    library = bpe.encoding(path, pattern)
    found = {r.doc_id: r for r in bpe.round_trip(docs, path, pattern).collect()}
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        row = found[doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(utf8(text)))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab' s1.\n\t é　|"), max_size=80), st.integers(1, 9))
def test_bpe_pieces_do_not_change_the_ids(text, size):
    path, pattern = rank_file()
    assert bpe.encode(text, path, pattern, size) == bpe.encoding(path, pattern).encode_ordinary(text)


def test_bpe_without_any_place_to_cut_and_raw_bytes(docs, none):
    path, pattern = rank_file()
    text = "ab" * 3_000 + "é\n" * 3_000
    assert bpe.encode(text, path, pattern, 64) == bpe.encoding(path, pattern).encode_ordinary(text)
    half = bpe.encode("é漢", path, pattern)[:-1]
    assert bpe.decode(half, path, pattern) == "é漢".encode()[: len(bpe.decode(half, path, pattern))]
    assert bpe.round_trip(none, path, pattern).count() == 0
    back = bpe.decoded(bpe.encoded(docs, path, pattern), path, pattern)
    assert Counter(bytes(r.bytes) for r in back.collect()) == Counter(utf8(r.text) for r in docs.collect())


def test_digests_are_those_of_the_real_outputs(docs, rows, monkeypatch):
    path, pattern = rank_file()
    called = []
    for name in ("encoded", "decoded"):
        monkeypatch.setattr(bpe, name, lambda *a, own=getattr(bpe, name), name=name: called.append(name) or own(*a))
    found = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(docs, path, pattern).collect()}
    assert called == ["encoded", "decoded"] and len(found) == len(rows)
    assert found == {r.doc_id: sha(" ".join(map(str, r.ids)).encode()) for r in bpe.encoded(docs, path, pattern).collect()}


# -- 5: token counts -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts_are_those_of_the_library(docs, rows, pieces):
    path, library = pieces
    for chunk in (token_count.CHUNK, 50):
        found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs, path, chunk).collect()}
        assert found == {d: (len(utf8(t)), len(library.encode(t or ""))) for d, t, _ in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst ▁_-.0123\n\té漢🙂=<>"), max_size=60))
def test_transducer_on_any_text(text):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_count.transducer(path).count(text) == len(library.encode(text))


def test_chunk_maps_compose_without_spaces(spark, none, pieces):
    path, library = pieces
    long = "internationalization" * 400 + "=" * 3_000 + " " * 999 + "ööö漢字" * 200
    given_ = table(spark, [(1, long, None), (1, long, None), (None, long[:7_000], None), (2, None, None)])
    found = sorted((r.doc_id or 0, r.n_tokens) for r in token_count.token_counts(given_, path, 500).collect())
    n = len(library.encode(long))
    assert found == [(0, len(library.encode(long[:7_000]))), (1, n), (1, n), (2, 0)]
    assert token_count.token_counts(none, path).count() == 0


def test_few_states_change_nothing(pieces):
    path, library = pieces
    machine = token_count.Transducer(token_count.Pieces(path), states=20)
    text = "The counts stay the same when compiled states are given up. " * 5
    assert machine.count(text) == len(library.encode(text))


# -- 6: SimHash ------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, words=4):
    import xxhash

    parts = utf8(text).lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))] if parts else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict[int, int], distance: int) -> dict[int, int]:
    label = {d: d for d in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: root(d) for d in fps}


def test_simhash_groups_are_those_of_brute_force(docs, rows):
    fps = {d: slow_fingerprint(t) for d, t, _ in rows}
    expected = slow_components(fps, 4)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r.fp % (1 << 64) for d, r in found.items()} == fps
    assert {d: r.component_id for d, r in found.items()} == expected
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    assert kept == set(expected.values())


@pytest.mark.parametrize("bucket", [8_192, 40])
def test_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, size=12, dtype=np.uint64)
    fps = {}
    for i in range(900):  # chains of close fingerprints, all of one half equal
        value = int(centres[i % 12]) | 0xFFFFFFFF if i % 3 else int(rng.integers(0, 2**63))
        for _ in range(i % 6):
            value ^= 1 << int(rng.integers(0, 64))
        fps[10 * i] = value
    nodes = {}
    for d, f in fps.items():
        nodes.setdefault(f, d)
    data = [(f - (1 << 64) if f >> 63 else f, d) for f, d in nodes.items()]
    links = simhash.bucket_links(spark.createDataFrame(data, "fp long, node long"), 4, bucket)
    found = {r.node: r.label for r in graph.components(links).collect()}
    expected = slow_components({d: f for f, d in nodes.items()}, 4)
    assert {d: found.get(d, d) for d in expected} == expected


def test_simhash_awkward_ids(spark, none):
    given_ = table(spark, [(3, "", None), (2, None, None), (2, None, None), (None, " ", None), (None, "only here", None)])
    found = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(given_).collect())
    assert found == {(3, 2): 1, (2, 2): 2, (None, 2): 1, (None, None): 1}
    assert simhash.near_duplicates(none).count() == 0


# -- 7: exact dedup --------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[utf8(t).lower()].append(d)
    expected = {d: (max(g), len(g), d == max(g), sha(text)) for text, g in groups.items() for d in g}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.deduplicate(docs, older_half()).collect()}
    assert found == expected
    assert {r.doc_id for r in exact_dedup.without_duplicates(docs, older_half()).collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.deduplicate(none, older_half()).count() == 0


def test_exact_dedup_repeated_rows_and_nulls(spark):
    given_ = table(spark, [(1, "A", None), (1, "A", None), (None, "a", None), (2, None, None), (4, "", None)])
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(given_, older_half()).collect())
    assert found == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (2, 4, 2, False): 1, (4, 4, 2, True): 1}
    assert sorted(r.doc_id for r in exact_dedup.without_duplicates(given_, older_half()).collect()) == [1, 4]


def test_a_repeated_id_keeps_no_copy(spark):
    given_ = table(spark, [(5, "A", None), (5, "B", None), (9, "A", None), (None, "x", None), (None, "b", None), (None, "a", None), (5, "b", None)])
    found = Counter((r.doc_id, r.text.lower()) for r in exact_dedup.without_duplicates(given_, older_half()).collect())
    assert found == {(5, "b"): 1, (9, "a"): 1, (None, "x"): 1}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1_000, 30_000])
def test_fuse_filter_holds_its_keys(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    made = exact_dedup.FuseFilter.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.holds(keys).all()
    assert made.holds(np.arange(20_000, dtype=np.uint64)).mean() < 0.001


# -- 8: repeated byte strings ----------------------------------------------------------------------------------------


def slow_spans(rows, length):
    seen, out = {}, {}
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        data = utf8(text)
        gone, own = bytearray(len(data)), []
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            else:
                own.append(window)
        seen.update((w, doc_id) for w in own)
        out[doc_id] = ([m.span() for m in re.finditer(b"\1+", bytes(gone))], bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("frequent", [1_024, 0])
def test_suffix_dedup_is_brute_force(docs, rows, monkeypatch, frequent):
    if not frequent:  # every anchor of the sampled documents counts as frequent
        monkeypatch.setattr(suffix_dedup, "FREQUENT", 0)
        monkeypatch.setattr(suffix_dedup, "LOOKED_AT", 1)
    found = {r.doc_id: ([(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in suffix_dedup.dedup_strings(docs).collect()}
    assert found == slow_spans(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab"), min_size=20, max_size=90), min_size=1, max_size=6), st.sampled_from([16, 20]))
def test_pieces_cover_each_window_once_and_agree(texts, length):
    held = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, held)])
    data = np.frombuffer(b"".join(held), np.uint8)
    made = suffix_dedup.Pieces(data, offsets, length)
    windows = sorted(s + i for s, n in zip(made.start.tolist(), made.windows.tolist(), strict=True) for i in range(n))
    assert windows == [o + i for o, t in zip(offsets, held, strict=False) for i in range(len(t) - length + 1)]
    place = {}
    for s, n, left, key in zip(made.start.tolist(), made.windows.tolist(), made.left.tolist(), made.key.tolist(), strict=True):
        for i in range(n):  # equal windows have one anchor at one shift
            assert place.setdefault(bytes(data[s + i : s + i + length]), (left - i, key)) == (left - i, key)


def test_suffix_dedup_awkward_ids(spark, none):
    line = "a passage that is comfortably longer than fifty bytes, twice. "
    given_ = table(spark, [(None, line, None), (9, line + line, None), (9, line * 3, None), (8, "x", None), (10, "12345" + line, None)])
    found = sorted((r.doc_id or 99, r.n_bytes, sum(s.end - s.start for s in r.removed)) for r in suffix_dedup.dedup_strings(given_).collect())
    n = len(line)
    assert found == [(8, 1, 0), (9, 2 * n, 0), (9, 3 * n, 0), (10, n + 5, n), (99, n, n)]
    assert suffix_dedup.dedup_strings(none).count() == 0


def runs_of_bytes():
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    table_rows = "".join("-" * 70 + noise(5) for _ in range(40))
    texts = ["-" * 900, noise(80) + "-" * 60 + noise(9) + "-" * 300, table_rows, "ab" * 200 + noise(30) + "ab" * 90, "abc" * 150, table_rows[3:900] + "ab" * 40, "=" * 400, "=" * 49]
    return [(i // 2 * 2 if i > 5 else i, t, None) for i, t in enumerate(texts)] + [(40 + i, "-" * (50 + i) + noise(3) + "ab" * 30, None) for i in range(20)]


@pytest.mark.parametrize(("at_once", "frequent"), [(3 << 20, 1_024), (200, 1_024), (777, 0), (3 << 20, 0)])
def test_runs_of_bytes_are_brute_force(spark, monkeypatch, at_once, frequent):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    if not frequent:
        monkeypatch.setattr(suffix_dedup, "FREQUENT", 0)
        monkeypatch.setattr(suffix_dedup, "LOOKED_AT", 1)
    rows = [(d, t, None) for d, t, _ in runs_of_bytes() if len(t) != 49]
    found = {r.doc_id: ([(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in suffix_dedup.dedup_strings(table(spark, rows)).collect()}
    assert found == slow_spans(rows, 50)


def test_rows_under_one_id_share_the_verdict_on_a_run(spark):
    rows = [(1, "x" * 60, None), (None, "a" + "x" * 300, None), (None, "b" + "x" * 200 + "c" + "x" * 90, None), (None, "short", None)]
    found = Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.dedup_strings(table(spark, rows)).collect())
    assert found == {(1, b"x" * 60): 1, (None, b"a"): 1, (None, b"bc"): 1, (None, b"short"): 1}


@pytest.mark.parametrize("frequent", [False, True])
def test_a_hot_window_travels_once_a_part(spark, frequent):
    import zstandard

    rows = [(i, "-" * 100_000, None) for i in (3, 4)] + [(5, "ab" * 50_000, None), (6, ("=" * 60 + "+") * 1_000, None)]
    batch = table(spark, rows).selectExpr("doc_id", "0L mark", "text").toArrow().combine_chunks().to_batches()
    keys = np.array([], np.uint64)
    if frequent:
        text = "".join(t for _, t, _ in rows).encode()
        keys = np.unique(suffix_dedup.Pieces(np.frombuffer(text, np.uint8), np.cumsum([0, *(len(t) for _, t, _ in rows)]), 50).key)
    dealt = [r for b in suffix_dedup._dealt(iter(batch), 50, 8, 0, 1, keys) for r in b.to_pylist() if not r["covered"]]
    sent = sum(len(zstandard.ZstdDecompressor().decompress(r["windows"])) for r in dealt)
    assert sent <= 200


def test_long_texts_come_in_overlapping_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 777)
    batch = table(spark, rows).selectExpr("doc_id", "0L mark", "text").toArrow().combine_chunks().to_batches()
    whole = {d: utf8(t) for d, t, _ in rows}
    windows = Counter()
    for who, text, offsets in suffix_dedup._parts(iter(batch), 50):
        for (d, _, at), a, b in zip(who, offsets[:-1], offsets[1:], strict=True):
            assert whole[d][at : at + b - a] == text[a:b]
            windows.update((d, at + i) for i in range(b - a - 49))
    assert windows == Counter((d, i) for d, t in whole.items() for i in range(len(t) - 49))


# -- 9: mixing -------------------------------------------------------------------------------------------------------


def slow_targets(sizes: dict, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        level = rest / max(1, sum(weight[s] for s in order if s not in capped))
        above = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


def test_mix_meets_its_targets(docs, rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    sums = Counter()
    for d, _, s in rows:
        sums[s] += size[d]
    expected, taken = slow_targets(dict(sums)), Counter()
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == sums[r.source] and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        assert r.target == pytest.approx(expected[r.source], rel=1e-12)
        taken[r.source] += r.taken
    mean = sum(sums.values()) / len(rows)
    assert all(abs(taken[s] - expected[s]) <= 2 * mean + 0.02 * expected[s] or s == max(sums, key=sums.get) for s in sums)
    again = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in found if r.copies})


def test_multipliers_solve_the_dual(spark):
    sizes = {1: [5, 9, 40, 1, 1, 300], 2: [7] * 50, 3: [1, 10_000]}
    goals = {1: 500.0, 2: 90.0, 3: 2_000.0}
    counts = spark.createDataFrame([(s, z, z / (sum(v) / len(v)), n) for s, v in sizes.items() for z, n in Counter(v).items()], "sid int, size long, x double, n long")
    wanted = spark.createDataFrame([(s, sum(sizes[s]), g) for s, g in goals.items()], "sid int, source_size long, target double")
    for r in mixing.multipliers(counts, wanted).collect():
        own = sizes[r.sid]
        mean = sum(own) / len(own)
        assert sum(z * 2 / (1 + math.exp(-r.lam * z / mean)) for z in own) == pytest.approx(goals[r.sid], rel=1e-5)


def test_mix_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    empty = [(r.target, r.taken) for r in mixing.mix(table(spark, [(1, None, "a"), (2, " ", None)])).collect()]
    assert empty == [(0.0, 0), (0.0, 0)]
    repeated = table(spark, [(1, "one two", "a")] * 5 + [(None, "three", None)])
    assert sum(r.taken for r in mixing.mix(repeated).collect()) <= 22
    assert mixing.mixed(repeated).count() <= 12


# -- 10: nearest neighbours ------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3_000, 24)).astype(np.float32)
    vectors[1_000:1_400] = vectors[0]  # a very common vector
    data = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(vectors)]
    bad = [(None, [1.0] * 24), (5_000, None), (5_100, [0.0] * 24), (5_200, [float("nan")] * 24), (5_300, [float("inf")] + [1.0] * 23), (5_400, [None] + [1.0] * 23), (5_500, [])]
    given_ = spark.createDataFrame(data + [(*b, "x", 1) for b in bad] + data[:1], "vec_id long, embedding array<float>, block string, size int")
    found = defaultdict(list)
    for r in ann.neighbours(given_).orderBy("query_id", "rank").collect():
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 3_000, 100))
    hits = 0
    for q, near in found.items():
        apart = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3_000), apart)) if i != q][:10]
        assert [s for _, s in near] == pytest.approx([apart[v] for v, _ in near], rel=1e-12)
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and len(near) == 10
        hits += len(set(order) & {v for v, _ in near})
    assert hits >= 0.9 * 10 * len(found)
    assert [v for v, _ in found[1_100]] == [0, *range(1_000, 1_009)]


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (200, [5.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.neighbours(few).collect()] == [(0, 1, 1.0)]
    assert ann.neighbours(few.limit(0)).count() == 0


# -- components ------------------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(1_000, i) for i in range(1_001, 1_400)] + [(7, 7), (None, 3)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 200 for i in range(200, 261)) and all(found[i] == 1_000 for i in range(1_000, 1_400)) and found[7] == 7
