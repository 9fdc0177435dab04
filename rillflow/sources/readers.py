"""Event streams from tables, files and functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..events import SEQ, TS, VALUE, EventStream
from ..ordering import numbered

#: The fields of a taxi trip's line, in order.
TAXI_FIELDS = (
    "medallion string, hack_license string, pickup_datetime timestamp, dropoff_datetime timestamp, trip_time_secs int, trip_distance float, pickup_long float, pickup_lat float, "
    "dropoff_long float, dropoff_lat float, payment_type string, fare float, surcharge float, mta_tax float, tip float, tolls float, total float"
)


#: Trips with equal times go by these, so that every trip has a number of its own.
TAXI_TIES = ("medallion", "pickup_datetime", "hack_license", "total")
HOUR = 3600


def _readings(rows: DataFrame, *order: str) -> EventStream:
    """Readings (ms, r) in order of time, numbered hour by hour; those of one millisecond go by ``order`` and value."""
    ties = F.struct(*order, "r") if order else F.col("r")
    rows = numbered(rows, SEQ, ["ms", ties], F.col("ms"), 1000 * HOUR)
    return EventStream.of(rows, SEQ, "r", F.timestamp_millis("ms"))


def table_events(df: DataFrame, seq: str | Column, value: str | Column, ts: str | Column | None = None, key: tuple[str, ...] = ()) -> EventStream:
    """A batch or streaming table as a stream."""
    return EventStream.of(df, seq, value, ts, key)


def live_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Files as they come; ``per_trigger`` bounds the files of a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def list_source(spark: SparkSession, make: Callable[[int], Any], value_type: T.DataType, per_second: int = 1) -> EventStream:
    """A live stream of what a function gives for 0, 1, 2 and so on, with the processing time."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return EventStream(rows.select(F.col("value").alias(SEQ), F.col("timestamp").alias(TS), F.udf(make, value_type, useArrow=True)("value").alias(VALUE)))


def read_taxi_csv(spark: SparkSession, path: str) -> EventStream:
    """Taxi trips, 17 fields a line; the event time is the drop-off, and trips are ordered by it."""
    rows = spark.read.schema(TAXI_FIELDS).csv(path)
    rows = rows.withColumn("payment_type", F.when(F.col("payment_type") == "CRD", "card").otherwise("cash"))
    seconds = F.coalesce(F.unix_seconds("dropoff_datetime"), F.lit(1 << 40))  # trips without a time come last
    rows = numbered(rows, SEQ, [seconds, *TAXI_TIES], seconds, HOUR)
    return EventStream.of(rows, SEQ, F.struct(*[c for c in rows.columns if c != SEQ]), "dropoff_datetime")


def _reading(x: Column, y: Column, z: Column, vibe: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"), vibe.cast("int").alias("vibe"))


def read_wearable_csv(spark: SparkSession, path: str) -> EventStream:
    """Accelerometer readings, a line each: ``epoch_ms,((x,y,z),vibe)``."""
    line = F.col("value")
    part = lambda k: F.regexp_extract(line, r"^(\d+),\(\((-?\d+),(-?\d+),(-?\d+)\),(\d+)\)", k)
    rows = spark.read.text(path).where(line.rlike(r"^\d+,\(\(")).select(part(1).cast("long").alias("ms"), _reading(part(2), part(3), part(4), part(5)).alias("r"))
    return _readings(rows)


def read_wearable_raw(spark: SparkSession, path: str) -> EventStream:
    """Raw readings: ``epoch_ms`` and ten groups of x, y, z, vibe a line; each group is an event, all with the line's time."""
    rows = spark.read.text(path).select(F.split("value", r"\s*,\s*").alias("f")).where(F.size("f") >= 41)
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: _reading(*[F.element_at("f", (2 + k * 4 + j).cast("int")) for j in range(4)]))
    rows = rows.select(F.element_at("f", 1).cast("long").alias("ms"), F.posexplode(groups).alias("at", "r"))
    return _readings(rows, "at")
