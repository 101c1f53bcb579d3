"""Close pairs of a position stream by sliding windows, in which no fix is too late."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.operators import proximity
from fairlead.session import children, exists

#: Panes whose fixes of a vessel are put in order together.
STRETCH = 1000


@dataclass
class PairWindows:
    """Pairs per window, out of mergeable states that grow with the fixes and not with the pairs.

    Windows are made of panes, the longest time that divides both width and slide. Every batch adds the latest fix of each
    vessel in each of its panes. Readers fold the batches; a fix then is a vessel's latest in one run of windows, which
    ends before the window that a later pane of the vessel belongs to, and meets others as such a run. Pairs are
    never stored, as they grow with the square of the vessels in the same waters. A batch that is written again replaces
    itself, and counts when it is complete.
    """

    folder: str
    width: str = "30 seconds"
    slide: str = "10 seconds"
    near_nm: float = proximity.NEAR_NM

    def _micros(self) -> tuple[int, int, int]:
        """Width, slide and pane."""
        width, slide = (pd.Timedelta(t) // pd.Timedelta(microseconds=1) for t in (self.width, self.slide))
        return width, slide, math.gcd(width, slide)

    def _folded(self, rows: DataFrame, *keys: str) -> DataFrame:
        names = [c for c in (*proximity.FIX, "seq") if c != "mmsi"]
        newest = F.max_by(F.struct(*names), F.struct("ts", "seq")).alias("fix")
        return rows.groupBy(*keys, "pane", "mmsi").agg(newest).select(*keys, "pane", "mmsi", "fix.*")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        micros, pane = F.unix_micros("ts"), self._micros()[2]
        # Whole numbers are divided, so that no rounding carries a fix into the next pane.
        number = F.floor((micros - F.pmod(micros, F.lit(pane))) / pane)
        fixes = self._folded(rows.where(F.col("ts").isNotNull()).withColumn("pane", number))
        fixes.write.mode("overwrite").parquet(f"{self.folder}/fixes/batch_id={int(batch_id)}")

    def _stored(self, spark: SparkSession) -> DataFrame:
        names = [n for n in children(spark, f"{self.folder}/fixes") if n.startswith("batch_id=")]
        done = [f"{self.folder}/fixes/{n}" for n in names if exists(spark, f"{self.folder}/fixes/{n}/_SUCCESS")]
        return spark.read.parquet(*done)

    def _spans(self, fixes: DataFrame) -> DataFrame:
        """Every fix with the first and the last window in which it is the latest of its vessel."""
        width, slide, pane = self._micros()
        k, step = width // pane, slide // pane
        # One exchange for the fold and the order: a stretch also has the panes behind its end that a window may reach.
        own = F.floor(F.col("pane") / STRETCH)
        spread = fixes.withColumns({"_own": own, "_stretch": F.explode(F.sequence(F.floor((F.col("pane") - (k - 1)) / STRETCH), own))})
        folded = self._folded(spread.repartition("mmsi", "_stretch"), "_own", "_stretch")
        following = F.lead("pane").over(Window.partitionBy("mmsi", "_stretch").orderBy("pane"))
        ordered = folded.withColumn("_next", following).where("_own = _stretch")

        def window(at: Column) -> Column:
            return F.floor(at / step)

        first, last = -window(-(F.col("pane") - (k - 1))), F.least(window(F.col("pane")), window(F.col("_next") - k))
        return ordered.select(*proximity.FIX, first.alias("first"), last.alias("last")).where("first <= last")

    def read(self, spark: SparkSession) -> DataFrame:
        """The pairs of every window, as far as the stream has come."""
        pairs = proximity.close_spans(self._spans(self._stored(spark)), self.near_nm)
        start = F.timestamp_micros(F.col("window") * self._micros()[1]).alias("window_start")
        return pairs.select(start, *[c for c in pairs.columns if c != "window"])
