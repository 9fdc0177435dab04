"""Merging streams of one type."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..events import SEQ, TS, VALUE, EventStream, micros
from ..ordering import numbered

_STREAM = "__stream"


def _together(streams: list[EventStream]):
    key = streams[0].key
    out = None
    for n, s in enumerate(streams):
        if s.key != key:
            raise ValueError("streams to merge need the same key")
        rows = s.df.select(*s.columns).withColumn(_STREAM, F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out, key


def merge(streams: list[EventStream], span_us: int = 3_600_000_000) -> EventStream:
    """The streams' events in order of time; ties by number of the stream, then by ``seq``.

    Timed events come in (time, stream, seq) order; streams without any times interleave, in (seq, stream) order. Of streams
    with both, untimed events come first. Positions are numbered by buckets of time (or of ``seq``), never by one global sort. For
    the reference order of ties see ``merge_exact``.
    """
    rows, key = _together(streams)
    first = streams[0]
    timed, untimed = rows.where(F.col(TS).isNotNull()), rows.where(F.col(TS).isNull())
    a = numbered(untimed.withColumnRenamed(SEQ, "__old"), SEQ, ["__old", _STREAM], F.col("__old"), first.bucket, key)
    b = numbered(timed.withColumnRenamed(SEQ, "__old"), SEQ, [TS, _STREAM, "__old"], micros(), span_us, key)
    count = untimed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")) if key else untimed.agg(F.count(F.lit(1)).alias("__n"))
    if key:
        renamed = count.select(*[F.col(k).alias(f"__k_{k}") for k in key], "__n")
        on = None
        for k in key:
            on = b[k].eqNullSafe(renamed[f"__k_{k}"]) if on is None else on & b[k].eqNullSafe(renamed[f"__k_{k}"])
        b = b.join(renamed, on, "left")
    else:
        b = b.join(F.broadcast(count))
    b = b.withColumn(SEQ, F.col(SEQ) + F.coalesce("__n", F.lit(0)))
    return first.with_df(a.select(*first.columns).unionByName(b.select(*first.columns)))


def _zipped(left: list, right: list) -> list:
    """Two streams of (time, payload): the earlier head goes first; of equal heads the second's, and the two change places after each."""
    out, i, j, a, b = [], 0, 0, left, right
    while i < len(a) and j < len(b):
        x, y = a[i][0], b[j][0]
        if x is not None and y is not None and not x < y:
            out.append(b[j])
            a, b, i, j = b, a, j + 1, i
        else:
            out.append(a[i])
            a, b, i, j = b, a, j, i + 1
    return out + a[i:] + b[j:]


def merge_exact(streams: list[EventStream]) -> EventStream:
    """A right fold of two-way merges whose sides change places after each event, exactly.

    Ties alternate, and untimed heads interleave. It runs in one task for each key and holds the key's events there: for small streams.
    """
    rows, key = _together(streams)
    first = streams[0]
    n_key, n = len(key), len(streams)
    names = [*key, SEQ, TS, VALUE]
    rows = rows.repartition(*[F.col(k) for k in key]) if key else rows.coalesce(1)

    def run(batches):
        groups: dict[tuple, list[list]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                groups.setdefault(row[:n_key], [[] for _ in range(n)])[row[-1]].append((row[n_key + 1], row))
        for parts in groups.values():
            out: list = []
            for part in reversed([sorted(p, key=lambda e: e[1][n_key]) for p in parts]):
                out = _zipped(part, out) if out else part
            table = [[*row[:n_key], k, *row[n_key + 1 : n_key + 3]] for k, (_, row) in enumerate(out)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in table], schema.field(c).type) for c in range(len(names))], names)

    return first.with_df(rows.select(*names, _STREAM).mapInArrow(run, first.df.select(*names).schema))
