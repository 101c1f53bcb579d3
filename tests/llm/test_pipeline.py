"""The pipeline, stage by stage against brute force, over the smallest given tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from fairlead.llm import bpe, mixing, toxicity
from fairlead.llm.common import stored_table
from fairlead.llm.queries import QUERIES, SQL, rank_file
from tests.llm.helpers import corpus, table
from tests.llm.test_text_operators import slow_components, slow_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    copies = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored_table(stage(spark, before, SF_DIR), "stage")
        if name == "toxicity":
            marks = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(before, marks).collect()}
            expected = {d for d in kept if not verdict[d]}
        elif name == "exact dedup":
            last = {}
            for d in sorted(kept):
                last[kept[d].text.encode().lower()] = d
            expected = set(last.values())
        elif name == "SimHash near-dedup":
            expected = set(slow_components({d: slow_fingerprint(r.text) for d, r in kept.items()}, 4).values())
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert set(copies) == set(kept) and Counter(r.doc_id for r in docs.collect()) == Counter({d: n for d, n in copies.items() if n})
            expected = {d for d, n in copies.items() if n}
        else:
            break
        assert docs.columns == columns
        found = {r.doc_id: r for r in docs.collect()}
        assert set(found) == expected and all(found[d] == kept[d] for d in found), name
        kept = found
    library = bpe.encoding(*rank_file())
    want = Counter()
    for d, row in kept.items():
        ids = library.encode_ordinary(row.text)
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(row.text.encode()).hexdigest(), tuple(ids))] += copies[d]
    plain = lambda rows: Counter((*r[:-1], tuple(r[-1])) for r in rows)
    assert plain(docs.collect()) == want
    assert plain(corpus_pipeline.run(spark, SF_DIR).collect()) == want


def test_stages_carry_other_columns_and_awkward_rows(spark, tmp_path):
    rows = corpus(seed=3, count=12) + [(None, "without an id", "b"), (1, "again", None), (1, "again", None)]
    docs = table(spark, rows)
    spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        step = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stored_table(stage(spark, step, str(tmp_path)), "stage")
            assert step.columns == docs.columns
        done = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path))
        assert done.count() == step.count()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
