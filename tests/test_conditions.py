"""Nested alert conditions against direct evaluation."""

from __future__ import annotations

import json
import operator
import random

import pytest
from pyspark.sql import functions as F

from fairlead.operators import conditions, skew

TESTS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "!=": operator.ne}


def value_of(node, row):
    """True, False or None (unknown), as SQL has it."""
    if "not" in node:
        inner = value_of(node["not"], row)
        return None if inner is None else not inner
    for kind, stop in (("and", False), ("or", True)):
        if kind in node:
            inner = [value_of(c, row) for c in node[kind]]
            return stop if stop in inner else None if None in inner else not stop
    have = row.get(node["metric"])
    return None if have is None or isinstance(have, str) != isinstance(node["value"], str) else TESTS[node["op"]](have, node["value"])


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        if rng.random() < 0.3:
            return {"metric": "kind", "op": rng.choice(["=", "!=", "<"]), "value": rng.choice("abc")}
        return {"metric": rng.choice("xyz"), "op": rng.choice(list(TESTS)), "value": rng.randint(0, 4)}
    kind = rng.choice(["and", "or", "not"])
    return {kind: tree(rng, depth - 1)} if kind == "not" else {kind: [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_direct_evaluation(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(conditions.skew, "fits_broadcast", lambda dim, max_rows=1: False)
    rng = random.Random(seed)
    draw = lambda *xs: rng.choice([None, *xs])
    rows = [{"seq": i, "x": draw(0, 1, 2, 3, 4), "y": draw(0.0, 2.0, 4.0), "z": draw(1, 3), "kind": draw("a", "b", "c")} for i in range(60)]
    trees = [tree(rng, 4) for _ in range(40)]
    given = spark.createDataFrame([tuple(r.values()) for r in rows], "seq long, x int, y double, z int, kind string")
    rules = spark.createDataFrame(
        [(i, f"r{i}", "T", json.dumps(t), None, True) for i, t in enumerate(trees)], "id int, rule_name string, rule_type string, conditions string, severity string, is_active boolean"
    )
    found = conditions.matches(given, rules, {n: F.col(n) for n in ("x", "y", "z", "kind")}).select("seq", "rule_id").collect()
    expected = sorted((r["seq"], i) for r in rows for i, t in enumerate(trees) if value_of(t, r))
    assert sorted(map(tuple, found)) == expected and expected


def test_unreadable_rules_are_told(spark):
    texts = [None, "", "[]", "{}", '{"and": []}', '{"metric": "x", "op": "~", "value": 1}', '{"metric": "x", "op": ">", "value": true}', '{"metric": "x", "op": ">", "value": 1}', '{"or": [{"not": 3}]}']
    rules = spark.createDataFrame([(i, "r", "T", t, None, True) for i, t in enumerate(texts)], "id int, rule_name string, rule_type string, conditions string, severity string, is_active boolean")
    assert sorted(r.rule_id for r in conditions.unreadable(rules).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    rows = spark.createDataFrame([(1, 5.0), (2, 0.0)], "seq long, x double")
    assert [tuple(r) for r in conditions.matches(rows, rules, {"x": F.col("x")}).select("seq", "rule_id").collect()] == [(1, 7)]
    assert conditions.matches(rows, rules.limit(0), {"x": F.col("x")}).count() == 0


def test_a_tree_is_not_multiplied_out():
    wide = {"and": [{"or": [{"metric": "x", "op": "=", "value": i}, {"metric": "y", "op": "=", "value": i}]} for i in range(200)]}
    assert len(conditions.terms_of(wide)) == 400


def test_tasks_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(conditions, "TASK_ROWS", 50)
    rules = spark.createDataFrame([(1, "r", "T", json.dumps({"and": [{"metric": "x", "op": ">", "value": 99}]}), None, True)], "id int, rule_name string, rule_type string, conditions string, severity string, is_active boolean")
    found = conditions.matches(spark.range(5000).select(F.col("id").alias("seq"), (F.col("id") % 200).alias("x")), rules, {"x": F.col("x")})
    assert found.count() == 2500
    assert "hashpartitioning(seq" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 100)" in plan
