"""File and topic sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.session import children, dated

VESSEL_FILE = (
    "mmsi BIGINT, vessel_name STRING, imo BIGINT, call_sign STRING, type_code INT, latitude DOUBLE, "
    "longitude DOUBLE, area STRING"
)
VESSEL_FIELDS = 8


def vessel_file(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated vessel list: header, blank and ``#`` lines skipped; only rows of exactly eight good fields."""
    lines = spark.read.option("lineSep", "\n").text(path)
    kept = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    parts = kept.select(F.split("value", r"\|").alias("p")).where(F.size("p") == VESSEL_FIELDS)
    fields = [f.split() for f in VESSEL_FILE.split(", ")]
    typed = parts.select(
        *[
            (F.trim(F.get("p", F.lit(i))) if kind == "STRING" else F.trim(F.get("p", F.lit(i))).try_cast(kind)).alias(n)
            for i, (n, kind) in enumerate(fields)
        ]
    )
    # The header has no number in its numeric fields, so it goes out with the other unreadable rows.
    return typed.dropna(subset=[n for n, kind in fields if kind != "STRING"])


def topic(
    spark: SparkSession, name: str, *, servers: str | None = None, directory: str | None = None,
    offsets_per_trigger: int | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of message texts (``value``, ``arrived``), from the earliest offset.

    From Kafka where ``servers`` are given and the connector is on the class path; else from JSON-line files
    below ``directory/name``, one message text per line. A micro-batch takes all there is unless told otherwise.
    """
    if servers:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", name)
            .option("startingOffsets", "earliest")
        )
        if offsets_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
        return reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.text(f"{directory}/{name}")
    return rows.select("value", F.current_timestamp().alias("arrived"))


def publish(
    messages: DataFrame, name: str, batch_id: int, *, servers: str | None = None, directory: str | None = None
) -> None:
    """Hand (key, value) messages of a batch to a topic: to Kafka where ``servers`` are given, else as JSON lines.

    A replay of a batch replaces its files. Kafka gets its messages again; readers drop them by their ids.
    """
    if servers:
        keyed = messages.select(F.col("key").cast("string"), F.col("value").cast("string"))
        keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()
    else:
        messages.write.mode("overwrite").json(f"{directory}/{name}/batch_id={int(batch_id)}")


def write_segments(
    messages: DataFrame, name: str, directory: str, records: int, order: tuple[str, ...], texts: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Texts (``value``) as a topic folder of segments, in the order of the given columns, at most ``records`` each.

    With ``files_per_trigger`` a reader takes so many segments a poll, oldest first, as a consumer takes so many records;
    what it has read is in its checkpoint. One job writes all segments; their times of change, by which a file stream
    orders them, are set afterwards. Segments are packed, as brokers keep them: texts that repeat every field name take an eighth,
    and a segment is read whole anyway. ``texts`` makes the texts of rows that have none yet, once they are in order: the rows
    are looked at for their order first, which would make every text twice.
    """
    spark, path = messages.sparkSession, f"{directory}/{name}"
    parts = max(1, -(-messages.count() // (8 * records)))
    ordered = messages.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (texts(ordered) if texts else ordered).select("value").write.options(maxRecordsPerFile=records, compression="gzip").text(path)
    written = sorted(n for n in children(spark, path) if n.startswith("part-"))
    # Names are part-NNNNN-id-cMMM.txt.gz: partitions in the order of their rows, then the files of a partition.
    written.sort(key=lambda n: (n.split("-")[1], n.rsplit("-c", 1)[-1]))
    for i, file in enumerate(written):
        dated(spark, f"{path}/{file}", 1_000_000_000_000 + 1000 * i)


def export(rows: DataFrame, path: str, fmt: str) -> None:
    """Write a selection as csv, json, parquet, or one GeoJSON feature per line (column ``feature``)."""
    if fmt == "geojson":
        rows.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
    elif fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif fmt in ("json", "parquet"):
        rows.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt}")
