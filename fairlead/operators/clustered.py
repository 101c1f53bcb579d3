"""Stored tables laid out for the reads that pick a few rows: by key and time, by place, by word."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from fairlead.functions import geo, times
from fairlead.operators import spatial
from fairlead.session import children, stored_table

#: Folders into which keys, and words, are dealt.
BUCKETS = 64
#: Sizes of cells in degrees, the first one that of the stored cells, and how many cells a ring may take across.
CELL_SIZES, CELLS_ACROSS = (1.0, 4.0, 15.0, 90.0), 12
#: Kilometres of the first ring, by how much rings grow, and half the globe.
FIRST_RING, GROWTH, HALF_GLOBE = 25.0, 4.0, 20_100.0
#: Kilometres of the first circle of a join, which meets many points where rows are dense.
FIRST_CIRCLE = 0.1
#: Cells of a join, in degrees; nothing is stored by them.
JOIN_SIZES = (0.004, 0.016, 0.0625, 0.25, *CELL_SIZES)


def _bucket(values: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.hash(*values), F.lit(buckets))


@dataclass(frozen=True)
class KeyedHistory:
    """A history in folders by month and bucket of the key, its files sorted by key and time.

    A read of one key and a span of time opens the folders of its months and bucket, and in their files the row groups
    that can hold the key and the time. Files are ranged over (month, bucket, key, time), so they are even also where
    one key has most rows. ``kinds`` is the type of the rows.
    """

    path: str
    keys: tuple[str, ...]
    kinds: StructType
    buckets: int = BUCKETS

    def append(self, rows: DataFrame, row_group_bytes: int | None = None) -> None:
        placed = rows.withColumns({"ym": times.month_key(F.col("ts")), "bucket": _bucket([F.col(k) for k in self.keys], self.buckets)})
        place = ["ym", "bucket", *self.keys, "ts"]
        writer = placed.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("append").partitionBy("ym", "bucket")
        (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.kinds.fields]).add("ym", StringType()).add("bucket", IntegerType())).parquet(self.path)

    def of_key(self, spark: SparkSession, key: Sequence) -> DataFrame:
        """The rows of one key, with the month folder ``ym``."""
        values = [F.lit(v).cast(self.kinds[k].dataType) for k, v in zip(self.keys, key, strict=True)]
        rows = self.table(spark).where(F.col("bucket") == _bucket(values, self.buckets)).drop("bucket")
        for k, v in zip(self.keys, values, strict=True):
            # Named here, the test for null stays beside its key in what is pushed to the files.
            rows = rows.where(F.col(k).isNotNull() & (F.col(k) == v))
        return rows

    def between(self, spark: SparkSession, key: Sequence, start: Column, end: Column) -> DataFrame:
        """The rows of one key from ``start`` to ``end``, both included."""
        rows = self.of_key(spark, key).where(F.col("ts").isNotNull() & F.col("ts").between(start, end))
        return rows.where(F.col("ym").between(times.month_key(start), times.month_key(end))).drop("ym")

    def newest(self, spark: SparkSession, key: Sequence, by: Sequence[str] = ("ts", "seq")) -> DataFrame:
        """The newest row of one key, looked for from the last month back, so older folders stay closed."""
        months = sorted((n[3:] for n in children(spark, self.path) if n.startswith("ym=")), reverse=True)
        rows = self.of_key(spark, key)
        for ym in months:
            found = rows.where(F.col("ym") == ym)
            if found.limit(1).count():
                rows = found
                break
        return rows.drop("ym").orderBy(*[F.desc(c) for c in by]).limit(1)


@dataclass(frozen=True)
class PlacedTable:
    """Rows with a position, one per ``id``, in folders of stored cells; a crowded cell has several files."""

    path: str
    kinds: StructType
    id: str = "mmsi"

    def write(self, rows: DataFrame) -> None:
        size = CELL_SIZES[0]
        placed = rows.withColumns({"cell_y": F.floor(F.col("latitude") / size).cast("int"), "cell_x": F.floor(F.col("longitude") / size).cast("int")})
        place = ["cell_y", "cell_x"]
        placed.repartitionByRange(*place, self.id).sortWithinPartitions(*place, "latitude").write.mode("overwrite").partitionBy(*place).parquet(self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.kinds.fields]).add("cell_y", IntegerType()).add("cell_x", IntegerType())).parquet(self.path)

    def within(self, spark: SparkSession, lat: float, lon: float, km: float) -> DataFrame:
        """Rows at most ``km`` from a point with ``distance_km``; only the cells that the circle can touch are opened."""
        high, wide = spatial.reach_degrees(lat, km)
        size, rows = CELL_SIZES[0], self.table(spark)
        rows = rows.where(F.col("cell_y").between(math.floor((lat - high) / size), math.floor((lat + high) / size)))
        if wide < 180:
            west, east = math.floor((lon - wide) / size), math.floor((lon + wide) / size)
            around = round(360 / size)
            turns = [(west + t * around, east + t * around) for t in (-1, 0, 1)]
            inside = [F.col("cell_x").between(a, b) for a, b in turns if b >= -around // 2 and a <= around // 2]
            held = inside[0]
            for more in inside[1:]:
                held |= more
            rows = rows.where(held)
        return spatial.within_radius(rows, lat, lon, km).drop("cell_y", "cell_x")

    def nearest(self, spark: SparkSession, lat: float, lon: float, k: int = 10, first: float = FIRST_RING) -> DataFrame:
        """The ``k`` nearest rows, ties by id: rings of cells are opened until one holds k rows within its radius."""
        km = first
        while km < HALF_GLOBE and self.within(spark, lat, lon, km).limit(k).count() < k:
            km *= GROWTH
        return self.within(spark, lat, lon, min(km, HALF_GLOBE)).orderBy("distance_km", self.id).limit(k)

    def nearest_join(self, points: DataFrame, k: int = 10, first: float = FIRST_CIRCLE) -> DataFrame:
        """For every point (point_id, lat, lon) its ``k`` nearest rows: point_id, rank, distance_km and the row.

        Round by round the points whose circle holds k rows leave, the others go on with a wider one. A point meets the
        rows of the cells that its circle can touch, in cells that grow with the circle, by an equi-join. Circles begin
        small, so a point meets rows in proportion to ``k`` however dense they are, unless many share one place.
        """
        spark, km, done = points.sparkSession, first, None
        open_ = stored_table(points.select("point_id", "lat", "lon"), "points")
        rows = self.table(spark).drop("cell_y", "cell_x")
        while True:
            last = km >= HALF_GLOBE
            found = _met(open_, rows, min(km, HALF_GLOBE))
            best = Window.partitionBy("point_id").orderBy("distance_km", self.id)
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            ranked = stored_table(ranked, "nearest")
            full = ranked.where(F.col("rank") == k).select("point_id")
            kept = ranked if last else ranked.join(full, "point_id", "left_semi")
            done = kept if done is None else done.unionByName(kept)
            if last:
                return done
            open_ = stored_table(open_.join(full, "point_id", "left_anti"), "points")
            if not open_.limit(1).count():
                return done
            km *= GROWTH


def _met(points: DataFrame, rows: DataFrame, km: float) -> DataFrame:
    """Every point with the rows at most ``km`` away; a hair wider than the circle, so that rounding loses nothing."""
    angle, slack = km / geo.EARTH_RADIUS_KM, 1 + 1e-9
    high = math.degrees(angle) * slack
    cos = F.cos(F.radians("lat"))
    over_pole = (cos <= math.sin(min(angle, math.pi / 2))) | F.lit(angle >= math.pi / 2)
    wide = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi / 2)) / cos))) * slack)
    reach = F.greatest(wide, F.lit(min(high, 180.0)))
    size = F.coalesce(*[F.when(2 * reach <= s * CELLS_ACROSS, F.lit(s)) for s in JOIN_SIZES], F.lit(JOIN_SIZES[-1]))
    sized = points.withColumns({"wide": wide, "size": size})
    around = F.round(360.0 / F.col("size")).cast("long")
    cell = lambda x: F.floor(x / F.col("size"))
    xs = F.transform(F.sequence(cell(F.col("lon") - F.col("wide")), cell(F.col("lon") + F.col("wide"))), lambda c: F.pmod(c, around))
    ys = F.sequence(cell(F.greatest(F.lit(-90.0), F.col("lat") - high)), cell(F.least(F.lit(90.0), F.col("lat") + high)))
    sized = sized.withColumn("x", F.explode(F.array_distinct(xs))).withColumn("y", F.explode(ys)).drop("wide")
    grids = None
    # Cells of one circle differ in size by latitude only, so rows are seldom dealt out more than once.
    for s in sorted(r["size"] for r in sized.select("size").distinct().collect()) or JOIN_SIZES[-1:]:
        whole = round(360.0 / s)
        at = {"x": F.pmod(F.floor(F.col("longitude") / s), F.lit(whole)), "y": F.floor(F.col("latitude") / s), "size": F.lit(s)}
        grid = sized.where(F.col("size") == s).join(rows.withColumns(at), ["size", "x", "y"]).drop("size", "x", "y")
        grids = grid if grids is None else grids.unionByName(grid)
    away = geo.distance_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    return grids.withColumn("distance_km", away).where(F.col("distance_km") <= km).drop("lat", "lon")


@dataclass(frozen=True)
class NameIndex:
    """An inverted index of names: postings by word, and names by their beginning, both in folders by what is looked for.

    A batch of (id, name) adds the postings of its names and takes back those of the names it replaces, as rows of weight
    -1, so a batch is written without touching the others; a batch that is written again replaces itself.
    """

    path: str
    id: str = "mmsi"
    buckets: int = BUCKETS

    def _kinds(self, part: str) -> str:
        found = {"postings": "word string, ", "names": "lowered string, "}[part]
        return f"{self.id} bigint, name string, {found}weight int, batch int, bucket {'int' if part == 'postings' else 'string'}"

    def _read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.schema(self._kinds(part)).parquet(f"{self.path}/{part}")

    def add(self, names: DataFrame, batch: int) -> None:
        """Write a batch of (id, name), one row per id; ids met before have their name replaced."""
        spark = names.sparkSession
        new = names.select(self.id, F.col("name")).withColumn("weight", F.lit(1))
        if children(spark, f"{self.path}/names"):
            held = self._read(spark, "names").where(F.col("batch") < batch).groupBy(self.id, "name").agg(F.sum("weight").alias("n")).where("n > 0")
            old = held.join(names.select(self.id), self.id, "left_semi").select(self.id, "name", F.lit(-1).alias("weight"))
            new = new.unionByName(old)
        new = stored_table(new.where("name IS NOT NULL").withColumn("batch", F.lit(int(batch))), "index")
        words = new.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("name"), " "))))
        words = words.withColumn("bucket", _bucket([F.col("word")], self.buckets))
        lowered = new.withColumn("lowered", F.lower("name")).withColumn("bucket", _first(F.col("lowered")))
        for part, rows, key in (("postings", words, "word"), ("names", lowered, "lowered")):
            writer = rows.repartitionByRange("bucket", key, self.id).sortWithinPartitions("bucket", key, self.id).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/{part}")

    def frequencies(self, spark: SparkSession) -> DataFrame:
        """(word, names): in how many names a word is."""
        return self._read(spark, "postings").groupBy("word").agg(F.sum("weight").alias("names")).where("names > 0")

    def match(self, spark: SparkSession, text: str, limit: int = 20) -> DataFrame:
        """(id, name, score): names that share words with the text, most shared words first; only postings of its words are read."""
        wanted = list(dict.fromkeys(text.lower().split()))
        if not wanted:
            return self._read(spark, "postings").select(self.id, "name", F.lit(0).cast("long").alias("score")).limit(0)
        buckets = [r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "word string").select(_bucket([F.col("word")], self.buckets).alias("b")).collect()]
        rows = self._read(spark, "postings").where(F.col("bucket").isin(*sorted(set(buckets))) & F.col("word").isin(*wanted))
        shared = rows.groupBy(self.id, "name", "word").agg(F.sum("weight").alias("n")).where("n > 0")
        scored = shared.groupBy(self.id, "name").agg(F.count(F.lit(1)).alias("score"))
        return scored.orderBy(F.desc("score"), "name", self.id).limit(limit)

    def complete(self, spark: SparkSession, prefix: str, limit: int = 20) -> DataFrame:
        """(id, name) of the names that begin with the prefix, by name; a range of the sorted names is read."""
        low = prefix.lower()
        rows = self._read(spark, "names")
        if low:
            rows = rows.where((F.col("bucket") == F.lit(_head(low))) if len(low) >= 2 else F.startswith("bucket", F.lit(_head(low))))
            rows = rows.where((F.col("lowered") >= low) & F.startswith("lowered", F.lit(low)))
        held = rows.groupBy(self.id, "name").agg(F.sum("weight").alias("n")).where("n > 0").drop("n")
        return held.orderBy("name", self.id).limit(limit)


def _first(lowered: Column) -> Column:
    """Folder of a name: its first two characters as hexadecimal code points, so that any name gives a plain folder."""
    return F.concat(F.lit("p"), F.hex(F.encode(F.substring(lowered, 1, 2), "UTF-8")))


def _head(lowered: str) -> str:
    return "p" + lowered[:2].encode().hex().upper()
