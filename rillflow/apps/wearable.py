"""Wearable programs: steps from accelerometer readings (fields x, y, z, vibe), rates and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..events import SEQ, TS, VALUE, EventStream, micros
from ..functions import int_sqrt
from ..operators import ChopTime, filter_events, map_values, scan, sessions, steps, window_aggregate
from ..ordering import previous, running


def magnitudes(readings: EventStream) -> EventStream:
    """Length of each reading's vector, of readings taken while the motor is still."""
    still = filter_events(readings, lambda r: r["vibe"] == 0)
    squares = map_values(still, lambda r: F.struct((r["x"] * r["x"]).alias("x"), (r["y"] * r["y"]).alias("y"), (r["z"] * r["z"]).alias("z")))
    return map_values(squares, lambda r: int_sqrt(r["x"] + r["y"] + r["z"]))


def step_counts(readings: EventStream, threshold: int, ms: int) -> EventStream:
    """Steps (falls of the magnitude through a threshold) in each block of ``ms`` milliseconds."""
    return window_aggregate(steps(magnitudes(readings), threshold), ChopTime(ms), "count")


def rates(stream: EventStream, ms: int = 1000, with_empty: bool = True) -> DataFrame:
    """Events of each block, and the mean over it and the blocks before: seq, ts, n, mean (with or without empty blocks)."""
    ones = stream.with_df(stream.df.withColumn(VALUE, F.lit(1).cast("long")))
    blocks = window_aggregate(ones, ChopTime(ms), "count").df.withColumnRenamed(VALUE, "n")
    if not with_empty:
        blocks = blocks.where("n > 0")
    add = lambda a, b: a + b
    blocks = running(blocks, "total", F.sum, F.col("n"), add, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    blocks = running(blocks, "blocks", F.sum, F.lit(1).cast("long"), add, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    return blocks.select(*stream.key, SEQ, TS, "n", (F.col("total") / F.col("blocks").cast("double")).alias("mean"))


def rate_histogram(stream: EventStream, ms: int = 1000) -> DataFrame:
    """How many blocks had each number of events."""
    ones = stream.with_df(stream.df.withColumn(VALUE, F.lit(1).cast("long")))
    return window_aggregate(ones, ChopTime(ms), "count").df.groupBy(*stream.key, F.col(VALUE).alias("rate")).agg(F.count(F.lit(1)).alias("blocks"))


def histogram(stream: EventStream, of: Column) -> DataFrame:
    """For each value so far, how often it (or what is made of it) came up to now: a running histogram."""
    data = stream.data().with_df(stream.data().df.withColumn("__class", of))
    keyed = EventStream(data.df, (*stream.key, "__class"), stream.bucket)
    return scan(keyed, "count").df.withColumnRenamed("__class", "class").withColumnRenamed(VALUE, "n")


def session_lengths(stream: EventStream, gap_ms: int = 900_000) -> DataFrame:
    """Start and end of each session, and how many events it has."""
    rows = sessions(stream, gap_ms)
    return rows.groupBy(*stream.key, "session").agg(F.min(TS).alias("start"), F.max(TS).alias("end"), F.count(F.lit(1)).alias("n"))


def running_sessions(stream: EventStream, gap_ms: int = 900_000) -> DataFrame:
    """Timed events with their session and when it began (``start``), as known at each event."""
    rows = previous(stream.timed().df, "__before", micros(), [F.col(SEQ)], F.col(SEQ), stream.bucket, stream.key)
    new = F.col("__before").isNull() | (micros() - F.col("__before.v") > gap_ms * 1000)
    first = F.struct(F.when(new, F.col(SEQ)).alias("seq"), F.when(new, F.col(TS)).alias("ts"))
    rows = running(rows.withColumn("__first", first), "__start", F.max, F.col("__first"), F.greatest, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    one = F.when(F.col("__first.seq").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = running(rows, "session", F.sum, one, lambda a, b: a + b, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    return rows.select(*stream.columns, "session", F.col("__start.ts").alias("start"))


def select_session(stream: EventStream, session: int, gap_ms: int = 900_000) -> EventStream:
    return stream.with_df(sessions(stream, gap_ms).where(F.col("session") == session).drop("session"))


def selectivity(before: EventStream, after: EventStream) -> float:
    """Share of values that an operator passes; feeds a program's statistics."""
    n = before.data().df.count()
    return after.data().df.count() / n if n else 1.0
