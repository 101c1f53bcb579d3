"""Alert rules whose conditions are trees of and, or and not over (metric, operator, value), kept as JSON text.

A tree is turned into rows once: negations move to the terms, which leaves gates that need some of their children, and
every term becomes a row with the gates above it. Distinct terms meet the readings of their metric once, whatever the
number of rules that share them. A gate is met by counting: per position, rule and gate, the children that are met
against those needed, from the deepest gates to the root. So a tree costs its size; nothing is multiplied out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.operators import skew
from fairlead.session import stored_table

# The operators of a term, each with the one that holds when it does not.
NEGATED = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "=": "!=", "!=": "="}

#: Rows of a task. All counts and the final join share its memory, so tasks grow in number and not in size.
TASK_ROWS = 100_000
#: Parts into which the readings of a metric are dealt where the terms are too many to broadcast.
SALTS = 64

STEP = "struct<child:int,gate:int,need:int>"
TERM_ROWS = f"rule_id int, metric string, op string, number double, text string, path array<{STEP}>, error string"


class Malformed(ValueError):
    """A condition that cannot be evaluated."""


def terms_of(condition: object) -> list[tuple[str, str, float | None, str | None, list[tuple[int, int, int]]]]:
    """(metric, operator, number, text, path) of every term of a tree; a path leads from the term up to the root.

    A path holds (which child, of which gate, how many children that gate needs). Gates are numbered within the tree.
    """
    out: list = []
    gates = iter(range(1 << 31))

    def walk(node: object, above: list[tuple[int, int, int]], negated: bool) -> None:
        if not isinstance(node, dict):
            raise Malformed("a condition is an object")
        if set(node) == {"not"}:
            walk(node["not"], above, not negated)
        elif len(node) == 1 and set(node) <= {"and", "or"}:
            ((kind, children),) = node.items()
            if not isinstance(children, list) or not children:
                raise Malformed(f"{kind} needs a list of conditions")
            gate, need = next(gates), len(children) if (kind == "and") != negated else 1
            for number, child in enumerate(children):
                walk(child, [(number, gate, need), *above], negated)
        elif set(node) == {"metric", "op", "value"}:
            value, op = node["value"], node["op"]
            if op not in NEGATED or not isinstance(node["metric"], str):
                raise Malformed(f"unknown operator {op!r}")
            if isinstance(value, bool) or not isinstance(value, (int, float, str)):
                raise Malformed("a value is a number or a text")
            number = None if isinstance(value, str) else float(value)
            out.append((node["metric"], NEGATED[op] if negated else op, number, value if number is None else None, above))
        else:
            raise Malformed(f"unknown fields {sorted(node)}")

    walk(condition, [], False)
    return out


def term_rows(rules: DataFrame) -> DataFrame:
    """The terms of all rules of (id, conditions); a rule that cannot be read is one row with its ``error``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("rule_id", pa.int32()), ("metric", pa.string()), ("op", pa.string()), ("number", pa.float64()), ("text", pa.string()),
             ("path", pa.list_(pa.struct([(n, pa.int32()) for n in ("child", "gate", "need")]))), ("error", pa.string())]
        )
        for batch in batches:
            rows = []
            for rule_id, conditions in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for metric, op, number, text, path in terms_of(json.loads(conditions or "null")):
                        steps = [{"child": c, "gate": g, "need": n} for c, g, n in path]
                        rows.append({"rule_id": rule_id, "metric": metric, "op": op, "number": number, "text": text, "path": steps})
                except (Malformed, json.JSONDecodeError, RecursionError) as error:
                    rows.append({"rule_id": rule_id, "error": str(error) or type(error).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return rules.select(F.col("id").cast("int"), "conditions").mapInArrow(task, TERM_ROWS)


def unreadable(rules: DataFrame) -> DataFrame:
    """(rule_id, error) of the rules that cannot be evaluated."""
    return term_rows(rules).where("error IS NOT NULL").select("rule_id", "error")


def _holds() -> Column:
    def compared(value: Column, bound: Column) -> Column:
        tests = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "=": value == bound, "!=": value != bound}
        return F.coalesce(*[F.when(F.col("op") == op, test) for op, test in tests.items()])

    return F.coalesce(compared(F.col("_number"), F.col("number")), compared(F.col("_text"), F.col("text")), F.lit(False))


def met_terms(rows: DataFrame, terms: DataFrame, metrics: dict[str, Column], key: list[str]) -> DataFrame:
    """(key, term) of every distinct term of (term, metric, op, number, text) that a row's reading meets."""
    fields = {f.name: f.dataType.simpleString() for f in rows.select(*[c.alias(n) for n, c in metrics.items()]).schema}

    def reading(name: str, column: Column) -> Column:
        textual = fields[name] == "string"
        number = F.lit(None).cast("double") if textual else column.cast("double")
        return F.struct(F.lit(name).alias("_metric"), number.alias("_number"), (column if textual else F.lit(None).cast("string")).alias("_text"))

    read = rows.select(*key, F.explode(F.array(*[reading(n, c) for n, c in metrics.items()])).alias("_r")).select(*key, "_r.*")
    read = read.where(F.coalesce(F.col("_text"), F.col("_number").cast("string")).isNotNull())
    if skew.fits_broadcast(terms):
        met = read.join(F.broadcast(terms), (F.col("_metric") == F.col("metric")) & _holds())
    else:
        read = read.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
        copies = terms.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = read.join(copies, (F.col("_metric") == F.col("metric")) & (F.col("_salt") == F.col("_part")) & _holds())
    return met.select(*key, "term")


def matches(rows: DataFrame, rules: DataFrame, metrics: dict[str, Column], key: Iterable[str] = ("seq",)) -> DataFrame:
    """``rows`` with every active rule of (id, rule_name, rule_type, conditions, severity, is_active) that holds.

    Adds rule_id, rule_name, rule_type, severity. ``key`` names a row. ``metrics`` are numbers or texts; a reading that is
    null meets no term and no negated term, as in SQL. A rule that names an unknown metric cannot meet that term; rules
    that cannot be read match nothing and are listed by :func:`unreadable`. The rules are read when the query runs and
    stay distributed: only their distinct terms and their paths are broadcast, and only after a look at their size.
    """
    key = list(key)
    active = rules.where("is_active")
    located = term_rows(active).where("error IS NULL")
    same = ["metric", "op", "number", "text"]
    term = F.xxhash64(*same)  # a name of its own: two terms with one hash are kept apart by the fields below
    paths = located.select(F.struct(term.alias("hash"), *same).alias("term"), "rule_id", "path")
    terms = paths.select("term").distinct().select("term", "term.metric", "term.op", "term.number", "term.text")
    depth = located.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]

    # One exchange by key; the counts of all levels and the final join find the rows of a key together.
    rows = stored_table(rows, "readings")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    parted = rows.repartition(tasks, *key)
    met = met_terms(parted, terms, metrics, key)
    met = skew.join_dimension(met, paths, ["term"], spread=[F.col(k) for k in key], how="inner").drop("term")
    for level in range(depth, 0, -1):
        # Paths of this length give their first step's child to its gate; what is left of a met gate is one step shorter.
        # Shorter paths wait, each as a gate of its own that needs one.
        here, step = F.size("path") == level, F.col("path")[0]
        gate = F.when(here, F.struct(step["gate"].alias("gate"), step["need"].alias("need"))).alias("gate")
        above = F.when(here, F.slice("path", 2, level)).otherwise(F.col("path")).alias("above")
        counted = met.select(*key, "rule_id", "path").distinct().groupBy(*key, "rule_id", gate, above).agg(F.count(F.lit(1)).alias("n"))
        met = counted.where(F.col("n") >= F.coalesce("gate.need", F.lit(1))).select(*key, "rule_id", F.col("above").alias("path"))
    held = met.select(*key, "rule_id").distinct()
    named = active.select(F.col("id").cast("int").alias("rule_id"), "rule_name", "rule_type", "severity")
    found = parted.join(held, key)
    return skew.join_dimension(found, named, ["rule_id"], spread=[F.col(k) for k in key], how="inner").select(*rows.columns, "rule_id", "rule_name", "rule_type", "severity")
