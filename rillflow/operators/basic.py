"""Stateless operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..events import SEQ, TS, VALUE, EventStream
from ..ordering import numbered

ColumnFn = Callable[[Column], Column]


def filter_events(stream: EventStream, keep: ColumnFn) -> EventStream:
    """Events whose value satisfies the predicate (null counts as no); events without a value pass."""
    v = F.col(VALUE)
    return stream.with_df(stream.df.where(v.isNull() | F.coalesce(keep(v), F.lit(False))))


def map_values(stream: EventStream, f: ColumnFn) -> EventStream:
    """The function of each value; times stay, and events without a value pass."""
    v = F.col(VALUE)
    return stream.with_df(stream.df.withColumn(VALUE, F.when(v.isNotNull(), f(v))))


def expand(stream: EventStream) -> EventStream:
    """An event for each element of a list value, with the list's time.

    An empty list gives nothing, and an event without a value one without. The new order is that of the lists, then of the
    elements; positions are numbered without a global sort.
    """
    v = F.col(VALUE)
    element = stream.value_type.elementType
    some = F.when(v.isNull(), F.array(F.lit(None).cast(element))).otherwise(v)
    rows = stream.df.withColumnRenamed(SEQ, "__outer").select(*stream.key, "__outer", TS, F.posexplode(some).alias("__inner", VALUE))
    rows = numbered(rows, SEQ, ["__outer", "__inner"], F.col("__outer"), stream.bucket, stream.key)
    return stream.with_df(rows.select(*stream.columns))


def stream_graph(stream: EventStream, graph: ColumnFn) -> EventStream:
    """Runs a sub-query on each event by itself and merges what they give: ``graph`` makes a list of a value."""
    return expand(map_values(stream, graph))


def reduce_stream(stream: EventStream, aggregate: ColumnFn) -> DataFrame:
    """One row (per key) with an aggregate of all values; without a key there is a row for an empty stream too."""
    value = aggregate(F.col(VALUE)).alias(VALUE)
    return stream.df.groupBy(*stream.key).agg(value) if stream.key else stream.df.agg(value)
