"""Event streams as DataFrames.

An event has an optional time and an optional value; a stream is an ordered sequence of events. As a DataFrame has
no order, every stream has a column ``seq``, and all order-dependent operators go by it. ``key`` columns, if any,
make a table of many independent streams: every operator then works within a key, and work is spread by key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, TS, VALUE = "seq", "ts", "value"


@dataclass(frozen=True)
class EventStream:
    """``df`` has columns seq (bigint, unique within a key), ts (timestamp, may be null), value (may be null) and the key columns.

    ``bucket`` is the span of ``seq`` that one task should number or scan; see ``ordering``.
    """

    df: DataFrame
    key: tuple[str, ...] = ()
    bucket: int = 1 << 20

    @classmethod
    def of(cls, df: DataFrame, seq: str | Column, value: str | Column, ts: str | Column | None = None, key: Iterable[str] = (), bucket: int = 1 << 20) -> EventStream:
        """A stream of a table's rows; ``seq`` must order them."""
        column = lambda c: F.col(c) if isinstance(c, str) else c
        time = F.lit(None).cast("timestamp") if ts is None else column(ts).cast("timestamp")
        return cls(df.select(*key, column(seq).cast("long").alias(SEQ), time.alias(TS), column(value).alias(VALUE)), tuple(key), bucket)

    def with_df(self, df: DataFrame) -> EventStream:
        return replace(self, df=df)

    @property
    def columns(self) -> list[str]:
        return [*self.key, SEQ, TS, VALUE]

    @property
    def value_type(self) -> T.DataType:
        return self.df.schema[VALUE].dataType

    def data(self) -> EventStream:
        """The events with a value."""
        return self.with_df(self.df.where(F.col(VALUE).isNotNull()))

    def timed(self) -> EventStream:
        """The events with a time."""
        return self.with_df(self.df.where(F.col(TS).isNotNull()))

    def values(self) -> DataFrame:
        """The values in order, without events that have none."""
        return self.data().df.orderBy(*self.key, SEQ).select(*self.key, VALUE)


def micros(ts: str | Column = TS) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def from_values(spark: SparkSession, values: Iterable, value_type: str, times: Iterable | None = None) -> EventStream:
    """A stream of a list's values (None for events without one), untimed unless times are given."""
    values = list(values)
    times = [None] * len(values) if times is None else list(times)
    rows = [(i, t, v) for i, (t, v) in enumerate(zip(times, values, strict=True))]
    return EventStream(spark.createDataFrame(rows, f"{SEQ} bigint, {TS} timestamp, {VALUE} {value_type}"))


def retime(stream: EventStream, time: Column) -> EventStream:
    """Event times taken from payloads (an expression over ``value``); events without a value keep theirs."""
    return stream.with_df(stream.df.withColumn(TS, F.when(F.col(VALUE).isNotNull(), time.cast("timestamp")).otherwise(F.col(TS))))
