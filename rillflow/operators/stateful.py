"""Operators with an accumulator: scan, stateful filters, sessions.

Folds that Spark knows run as running aggregates, cut into buckets (see ``ordering``). Any other fold is sequential by nature:
``sequential`` streams a key's events through Python in order, batch by batch, and spreads work by key only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..events import SEQ, TS, VALUE, EventStream, micros
from ..ordering import numbered, previous, running

_FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda v: v, lambda a, b: a + b),
    "count": (F.sum, lambda v: F.when(v.isNotNull(), F.lit(1).cast("long")), lambda a, b: a + b),
    "min": (F.min, lambda v: v, F.least),
    "max": (F.max, lambda v: v, F.greatest),
}


def scan(stream: EventStream, fold: str) -> EventStream:
    """Running sum, count, min or max: after each value, the fold up to and with it. Events without a value pass."""
    aggregate, of, join = _FOLDS[fold]
    rows = running(stream.df, "__acc", aggregate, of(F.col(VALUE)), join, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    return stream.with_df(rows.withColumn(VALUE, F.when(F.col(VALUE).isNotNull(), F.col("__acc"))).select(*stream.columns))


def sequential(stream: EventStream, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, bool, Any]], out: T.DataType) -> EventStream:
    """Each key's events through ``step(state, value) -> (state, emit, value)`` in order; events without a value pass."""
    n_key = len(stream.key)
    schema = T.StructType([*[stream.df.schema[c] for c in (*stream.key, SEQ, TS)], T.StructField(VALUE, out)])
    rows = stream.df.select(*stream.columns)
    rows = rows.repartition(*[F.col(k) for k in stream.key]) if stream.key else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*stream.columns[: n_key + 1])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(out)
        at, state = None, start()
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(n_key)], strict=True)) if n_key else [()] * batch.num_rows
            keep, values = [], []
            for k, v in zip(keys, batch.column(n_key + 2).to_pylist(), strict=True):
                if k != at:
                    at, state = k, start()
                emit, new = True, None
                if v is not None:
                    state, emit, new = step(state, v)
                keep.append(emit)
                if emit:
                    values.append(new)
            kept = batch.select(list(range(n_key + 2))).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values, kind)], [*kept.schema.names, VALUE])

    return stream.with_df(rows.mapInArrow(run, schema))


def scan_fold(stream: EventStream, f: Callable[[Any, Any], Any], initial: Any, out: T.DataType) -> EventStream:
    """General scan: after each value, the new accumulator (never the initial one)."""

    def step(acc, v):
        acc = f(acc, v)
        return acc, True, acc

    return sequential(stream, lambda: initial, step, out)


def filter_acc(stream: EventStream, f: Callable[[Any, Any], Any], initial: Any, keep: Callable[[Any, Any], bool]) -> EventStream:
    """General stateful filter: ``keep(value, accumulator)`` sees the old accumulator, which advances whether or not the event passes."""
    return sequential(stream, lambda: initial, lambda acc, v: (f(acc, v), bool(keep(v, acc)), v), stream.value_type)


def changes(stream: EventStream, of: Callable[[Column], Column] = lambda v: v) -> EventStream:
    """Values that differ from the value before (by a component of them, if given); the first passes."""
    data = previous(stream.data().df, "__before", of(F.col(VALUE)), [F.col(SEQ)], F.col(SEQ), stream.bucket, stream.key)
    new = F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(of(F.col(VALUE)))
    rows = data.where(new).select(*stream.columns)
    return stream.with_df(rows.unionByName(stream.df.where(F.col(VALUE).isNull()).select(*stream.columns)))


def sample(stream: EventStream, n: int) -> EventStream:
    """One value in ``n + 1``: the (n+1)th, the 2(n+1)th and so on. Events without a value pass."""
    data = numbered(stream.data().df, "__at", [SEQ], F.col(SEQ), stream.bucket, stream.key).where((F.col("__at") + 1) % (n + 1) == 0)
    return stream.with_df(data.select(*stream.columns).unionByName(stream.df.where(F.col(VALUE).isNull()).select(*stream.columns)))


def steps(stream: EventStream, threshold, initial=0) -> EventStream:
    """Values at or under a threshold whose predecessor is over it: the falls of a signal."""
    data = previous(stream.data().df, "__before", F.col(VALUE), [F.col(SEQ)], F.col(SEQ), stream.bucket, stream.key)
    before = F.coalesce(F.col("__before.v"), F.lit(initial))
    rows = data.where((before > threshold) & (F.col(VALUE) <= threshold)).select(*stream.columns)
    return stream.with_df(rows.unionByName(stream.df.where(F.col(VALUE).isNull()).select(*stream.columns)))


def record_highs(stream: EventStream) -> EventStream:
    """Values above all before them."""
    data = running(stream.data().df, "__top", F.max, F.col(VALUE), F.greatest, [SEQ], F.col(SEQ), stream.bucket, stream.key, inclusive=False)
    rows = data.where(F.col("__top").isNull() | (F.col(VALUE) > F.col("__top"))).select(*stream.columns)
    return stream.with_df(rows.unionByName(stream.df.where(F.col(VALUE).isNull()).select(*stream.columns)))


def sessions(stream: EventStream, gap_ms: int) -> DataFrame:
    """Timed events with ``session``, counted from 1: a new one begins after a gap of more than ``gap_ms``."""
    rows = previous(stream.timed().df, "__before", micros(), [F.col(SEQ)], F.col(SEQ), stream.bucket, stream.key)
    new = F.col("__before").isNull() | (micros() - F.col("__before.v") > gap_ms * 1000)
    rows = rows.withColumn("__new", F.when(new, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = running(rows, "session", F.sum, F.col("__new"), lambda a, b: a + b, [SEQ], F.col(SEQ), stream.bucket, stream.key)
    return rows.select(*stream.columns, "session")


def map_cache(stream: EventStream, f: Callable[[Column], Column]) -> EventStream:
    """A map that computes an expensive function once for each distinct value."""
    v = F.col(VALUE)
    table = stream.df.select(VALUE).where(v.isNotNull()).distinct().select(v.alias("__in"), f(v).alias("__out"))
    rows = stream.df.join(table, v == F.col("__in"), "left")
    return stream.with_df(rows.select(*stream.key, SEQ, TS, F.col("__out").alias(VALUE)))
