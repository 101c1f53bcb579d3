"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Every document gets a rate between 0 and 2, the expected number of its copies. Among all rates that give each source
its target of tokens the most even ones (largest entropy, base rate 1) are exponentially tilted: the odds
q / (2 - q) are exp(lambda * x), with x the document's size over the mean of its source. The multipliers solve the
convex dual by Newton steps; each step is one distributed aggregation over the counts of (source, size), kept inside a
bracket so that it cannot run away. Rates become whole copies by systematic rounding along documents of like size, in
slices that no source can make large; the longer documents come first and the shorter ones absorb what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import packed, same_id, stored_table

#: Weights of the sources in code-point order, repeated, and what they share of all sizes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No source and no document is taken more often than this.
MOST = 2
#: Rows of a slice on average, and the fewest parts of a source's size class.
SLICE = 1 << 18
LEAST_SALTS = 32
#: Rates are rounded in fixed point, so that sums do not depend on their order.
UNIT = 1 << 30
_STEPS = 60
_CLOSE = 1e-9


def size_of(text: str = "text") -> Column:
    """Number of runs of characters other than the six ASCII white-space ones; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, key: str = "source") -> DataFrame:
    """(doc_id, source, size) of every row, stored."""
    return stored_table(docs.select("doc_id", F.col(key).alias("source"), size_of().alias("size")), "sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, sid, n, source_size, target, mean), one row per source, stored.

    The windows see one row per source, never documents. Sources in order of cap over weight are capped as long as the
    common level of those after them lies above their cap; the rest shares what is left by weight.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * float(share)
    ranked = ranked.withColumn("budget", budget).withColumn("all_w", F.sum("w").over(everything))
    ranked = ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = (F.col("budget") - F.col("capped_before")) / (F.col("all_w") - F.col("w_before"))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    # The first source that is not capped sets the level of all after it.
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(everything).getField("level")
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(common * F.col("w"), F.col("cap")))
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0))
    return stored_table(ranked.select("source", "sid", "n", "source_size", target.alias("target"), mean.alias("mean")), "targets")


def rate(multiplier: Column, x: Column) -> Column:
    return F.lit(float(MOST)) / (F.lit(1.0) + F.exp(-multiplier * x))


def multipliers(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """(sid, lam) by Newton's method on the dual; ``counts`` has sid, size, x and n documents."""
    ratio = F.col("target") / F.col("source_size")
    start = F.when(ratio < MOST, F.log(ratio / (MOST - ratio)))
    open_ = goals.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * (MOST - 1e-9)))
    state = stored_table(open_.select("sid", "target", start.alias("lam"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(1.0).alias("off")), "multipliers")
    for _ in range(_STEPS):
        q = rate(F.col("lam"), F.col("x"))
        tokens = F.col("size") * F.col("n")
        sums = counts.join(state.select("sid", "lam"), "sid").groupBy("sid").agg(F.sum(tokens * q).alias("taken"), F.sum(tokens * F.col("x") * q * (1 - q / MOST)).alias("slope"))
        at = state.drop("off").join(sums, "sid").withColumn("gap", F.col("taken") - F.col("target"))
        at = at.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        after = F.when(F.col("gap") == 0, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored_table(at.select("sid", "target", after.alias("lam"), "low", "high", (F.abs("gap") / F.col("target")).alias("off")), "multipliers")
        if not state.where(F.col("off") > _CLOSE).limit(1).count():
            break
    else:
        raise RuntimeError(f"the multipliers did not come within {_CLOSE} of the targets in {_STEPS} steps")
    return state.select("sid", F.round("lam", 7).alias("lam"))


def _rounded(rows: DataFrame, salts: int) -> DataFrame:
    """Add ``copies`` to rows (doc_id, sid, size, q): whole copies whose running sum follows that of the rates."""
    fixed = F.round(F.col("q") * UNIT).cast("long")
    spread = F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts))
    rows = rows.withColumn("f", fixed).withColumn("bin", F.floor(F.log2(F.col("size") + 1.0) * 8)).withColumn("salt", spread)
    place = ["sid", "bin", "salt"]
    sums = rows.groupBy(*place).agg(F.sum("f").alias("own"))
    earlier = Window.partitionBy("sid").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*place, F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*place).orderBy("size", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.join(starts, place).withColumn("upto", F.col("before") + F.sum("f").over(upto) + UNIT // 2)
    whole = lambda c: F.floor(c / F.lit(float(UNIT)))
    return ran.select("doc_id", "sid", "size", "q", (whole(F.col("upto")) - whole(F.col("upto") - F.col("f"))).cast("long").alias("copies"))


def mix(docs: DataFrame, key: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Whole copies of every row: doc_id, source, size, source_size, target, copies, taken.

    Sources are the values of ``key``, null being one of its own and the last. Documents without words get rate 1 and
    take nothing. A row is copied at most twice. Rows that repeat a doc_id are documents of their own; a null doc_id
    is allowed. Empty input gives no rows; if no text has words all targets are zero. Reruns agree. Other columns are
    ignored.
    """
    rows = sized(docs, key)
    goals = targets(rows, weights, share)
    salts = max(LEAST_SALTS, rows.count() // SLICE)
    named = rows.join(goals.select(F.col("source").alias("_source"), "sid", "mean"), same_id(F.col("source"), F.col("_source")))
    named = stored_table(named.select("doc_id", "sid", "size", (F.col("size") / F.col("mean")).alias("x")), "named")
    counts = stored_table(named.groupBy("sid", "size", "x").agg(F.count(F.lit(1)).alias("n")), "counts")
    solved = goals.join(multipliers(counts, goals), "sid", "left").select("sid", "target", "lam", (F.col("source_size") > 0).alias("words"))
    solved = stored_table(solved, "solved")
    q = F.when(~F.col("words") | (F.col("size") == 0), 1.0).when(F.col("lam").isNull(), float(MOST)).otherwise(rate(F.col("lam"), F.col("x")))
    rated = named.join(solved, "sid").select("doc_id", "sid", "size", "x", q.alias("q"))
    long = stored_table(_rounded(rated.where("x > 1"), salts), "long")
    # The shorter documents meet what the longer ones leave of the target.
    taken = long.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("took"))
    short = rated.where("x <= 1")
    sums = short.groupBy("sid").agg(F.sum(F.col("q") * F.col("size")).alias("due"), F.sum((MOST - F.col("q")) * F.col("size")).alias("room"))
    rest = solved.join(taken, "sid", "left").join(sums, "sid").withColumn("left", F.col("target") - F.coalesce("took", F.lit(0)))
    share_of = lambda a, b: F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b))).otherwise(0.0)
    up = F.when(F.col("left") > F.col("due"), share_of(F.col("left") - F.col("due"), F.col("room"))).otherwise(0.0)
    down = F.when(F.col("left") < F.col("due"), share_of(F.col("left"), F.col("due"))).otherwise(1.0)
    rest = stored_table(rest.select("sid", F.round(up, 9).alias("up"), F.round(down, 9).alias("down")), "rest")
    moved = F.when(F.col("size") == 0, F.col("q")).otherwise(F.col("q") * F.col("down") + (MOST - F.col("q")) * F.col("up"))
    short = short.join(rest, "sid").select("doc_id", "sid", "size", moved.alias("q"))
    copies = long.unionByName(_rounded(short, salts)).join(goals.select("sid", "source", "source_size", "target"), "sid")
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns.

    Rows with the same id and size share their copies evenly, which differ by one at most.
    """
    of_id = mix(docs, key).groupBy("doc_id", "size").agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("all_rows"))
    of_id = of_id.select(F.col("doc_id").alias("mixed_id"), F.col("size").alias("mixed_size"), "all_copies", "all_rows")
    rows = packed(docs, id=F.col("doc_id"), size=size_of())
    rows = rows.join(of_id.hint("merge"), same_id(F.col("id"), F.col("mixed_id")) & (F.col("size") == F.col("mixed_size")))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "size").orderBy("id")))
    times = F.floor(F.col("all_copies") / F.col("all_rows")) + F.when(F.col("turn") <= F.col("all_copies") % F.col("all_rows"), 1).otherwise(0)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")
