"""The factorization machine learns what a linear model cannot, and holds on documents it has not seen."""

from __future__ import annotations

import random

import numpy as np

from fairlead.llm import toxicity
from tests.llm.helpers import table


def test_pairs_are_learned():
    rng = random.Random(4)
    rows, toxic = [], []
    for _ in range(1_500):  # slots: 0 insult, 1 group, 2 to 9 others
        own = {s for s in (0, 1) if rng.random() < 0.5} | {s for s in range(2, 10) if rng.random() < 0.3}
        rows.append(sorted(own))
        toxic.append(float({0, 1} <= own))
    machine = toxicity.Machine({}, *toxicity.fit(rows, np.array(toxic), 10))
    assert machine.score([0, 1]) > 0.8 and max(machine.score([0]), machine.score([1]), machine.score([])) < 0.2


def test_held_out_documents(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1_200):
        words = rng.choices(plain, k=rng.randint(5, 60))
        bad = i % 7 == 0
        if bad:
            words += [rng.choice(["vile", "awful", "scoundrel"]) for _ in range(2)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), None))
        labels.append((i, int(bad), 1))
    rows += [(None, None, None), (5_000, "", None), (5_001, "vile awful scoundrel scoundrel", None)]
    labels += [(None, 1, 1), (3, None, 1), (1, 0, 1), (1, 0, 1)]
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    wrong = sum(found[d].predicted != int(d % 7 == 0) for d in range(1_200) if found[d].held_out)
    assert wrong <= 0.02 * sum(r.held_out for r in found.values()) and found[5_001].predicted == 1 and found[5_000].predicted == 0
    kept = {r.doc_id for r in toxicity.without_toxic(docs, marks).collect()}
    assert kept == {d for d, r in found.items() if not r.predicted}


def test_without_labels_or_documents(spark):
    docs = table(spark, [(1, "text", None), (2, None, None)])
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.toxicity(docs, no_labels).collect()}
    assert len(scores) == 1
    assert toxicity.toxicity(table(spark, []), no_labels).count() == 0


def test_scores_do_not_depend_on_the_order_of_the_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=4)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(150)]
    texts = [t + " vile" if i < 40 else t for i, t in enumerate(texts)]
    rows = [(i, texts[i % 150], None) for i in range(600)]  # equal texts, labelled differently
    marks = spark.createDataFrame([(i, int(rng.random() < (0.7 if i % 150 < 40 else 0.05))) for i in range(600)], "doc_id long, toxic int")
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(table(spark, rows).repartition(n), marks.repartition(n)).collect()} for n in (1, 3, 7)]
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) > 1
