"""Counts by group over sliding time windows, without a row for each event and window.

A block of time and the block after it hold every window that begins in the block. Within them an event is a point (place, time) and
the window of another a quadrant: events at its place or later, and before its end. ``dominance`` sums points by quadrant for a few
windows at a time, from one histogram of the points before them; so a block of n events takes about n * sqrt(n) steps, not n * n rows.
Where times fall along ``seq``, a window holds later events back to the start of its own block of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..events import SEQ, VALUE, EventStream, micros
from ..ordering import numbered
from .windows import WINDOW, SlidingTime

#: Windows that are counted at a time, at least; and counts that are held at a time.
WIDTH, CELLS = 128, 1 << 22
#: The place of a group that a window does not have.
ABSENT = -(1 << 62)

Kernel = Callable[[pa.Table], Iterator[pa.RecordBatch]]


def by_block(stream: EventStream, span: int, columns: list[Column], kernel: Kernel, schema: T.StructType | str) -> DataFrame:
    """``kernel`` on each block of ``span`` microseconds: window_id, us, own (not of the block after), has (a value), and ``columns``."""
    if stream.key:
        raise ValueError("ranked windows take streams without a key")
    rows = numbered(stream.timed().df, WINDOW, [SEQ], F.col(SEQ), stream.bucket)
    rows = rows.select(WINDOW, micros().alias("us"), F.col(VALUE).isNotNull().alias("has"), *columns)
    rows = rows.withColumn("__of", F.floor(F.col("us") / F.lit(span)).cast("long")).withColumn("__block", F.explode(F.array(F.col("__of"), F.col("__of") - 1)))
    rows = rows.withColumn("own", F.col("__of") == F.col("__block")).drop("__of")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes are not put in one task
    rows = rows.repartition(parts, "__block").sortWithinPartitions("__block")

    def run(batches):
        held, at = [], None
        for batch in batches:
            block = batch.column("__block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)] if len(block) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and block[lo] != at:
                    yield from kernel(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                at = block[lo]
        if held:
            yield from kernel(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def coded(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of some columns: the number of each in their order (nulls first), and a row that has each number."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        found = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode") if column.num_chunks else pa.array([], column.type).dictionary_encode()
        values = found.dictionary.to_pylist()
        rank = np.empty(len(values), np.int64)
        rank[sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i]))] = np.arange(len(values))
        _, code = np.unique(code * max(1, len(values)) + rank[found.indices.to_numpy()], return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def dominance(at: np.ndarray, below: np.ndarray, weight: np.ndarray, code: np.ndarray, codes: int, place: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, their sums by code), a few windows at a time: the weights of points with ``at >= place`` and ``below < until``."""
    order = np.argsort(-at, kind="stable")
    back, below, weight, code = -at[order], below[order], weight[order], code[order]
    turn = np.argsort(-place, kind="stable")
    width = max(1, min(max(WIDTH, isqrt(len(at))), CELLS // max(1, codes)))
    for lo in range(0, len(turn), width):
        q = turn[lo : lo + width]
        p, u = place[q], until[q]
        sure, some = np.searchsorted(back, [-p[0], -p[-1]], "right")
        ends = np.sort(u)
        slot = np.searchsorted(ends, below[:sure], "right")
        sums = np.bincount(slot * codes + code[:sure], weight[:sure], (len(q) + 1) * codes).reshape(-1, codes)[:-1].cumsum(axis=0)
        sums = sums[np.searchsorted(ends, u)].astype(float, copy=False)
        for a in range(sure, some, 4 * width):
            b = min(some, a + 4 * width)
            hit = (back[a:b] <= -p[:, None]) & (below[a:b] < u[:, None])
            part = np.zeros((b - a, codes))
            part[np.arange(b - a), code[a:b]] = weight[a:b]
            sums += hit.astype(float) @ part
        yield q, np.rint(sums).astype(np.int64)


def leading(amounts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the places of the ``k`` largest amounts, equal ones by place; and which of these are there (not ``ABSENT``)."""
    top = np.argsort(-amounts, axis=1, kind="stable")[:, :k]
    return top, np.take_along_axis(amounts, top, axis=1)


def texts(top: np.ndarray, amounts: np.ndarray, labels: list[str]) -> list[str]:
    """Each row's entries by rank, as what:amount."""
    return [",".join([labels[c] + str(n) for c, n in zip(cs, ns) if n != ABSENT]) for cs, ns in zip(top.tolist(), amounts.tolist())]


def _counts(table: pa.Table, maker: SlidingTime, ties: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the block's windows, counts by group, a row of each group); a window with nothing in it counts nothing."""
    place = numbers(table, "us" if maker.peers else WINDOW)
    us, own, has = numbers(table, "us"), np.flatnonzero(numbers(table, "own")), np.flatnonzero(numbers(table, "has"))
    if len(own) and len(has):
        code, first = coded([table.column(t).take(pa.array(has)) for t in ties])
        for q, counts in dominance(place[has], us[has] - maker.ms * 1000, np.ones(len(has)), code, len(first), place[own], us[own]):
            yield own[q], np.where(counts > 0, counts, ABSENT), has[first]


def top_counts(stream: EventStream, maker: SlidingTime, k: int) -> DataFrame:
    """The ``k`` most frequent values of each window, ties by value: window_id, value, n, rank (from 1)."""
    schema = T.StructType().add(WINDOW, T.LongType()).add(VALUE, stream.value_type).add("n", T.LongType()).add("rank", T.LongType())

    def kernel(table):
        for rows, counts, first in _counts(table, maker, [VALUE]):
            top, n = leading(counts, k)
            there = n != ABSENT
            ids = np.broadcast_to(numbers(table, WINDOW)[rows][:, None], n.shape)[there]
            rank = np.broadcast_to(np.arange(1, n.shape[1] + 1), n.shape)[there]
            values = pa.concat_arrays(table.column(VALUE).take(pa.array(first[top[there]])).chunks)
            yield pa.RecordBatch.from_arrays([pa.array(ids), values, pa.array(n[there]), pa.array(rank)], [WINDOW, VALUE, "n", "rank"])

    return by_block(stream, maker.micros, [F.col(VALUE)], kernel, schema)


def top_texts(stream: EventStream, maker: SlidingTime, k: int, group: list[Column]) -> DataFrame:
    """The ``k`` most frequent groups of each window that has one, as a text: window_id, us, value."""
    ties = [f"g{i}" for i in range(len(group))]
    label = F.concat_ws(":", *[g.cast("string") for g in group], F.lit(""))

    def kernel(table):
        labels = None
        for rows, counts, first in _counts(table, maker, ties):
            labels = labels or table.column("label").take(pa.array(first)).to_pylist()
            top, n = leading(counts, k)
            some = n[:, 0] != ABSENT
            yield text_batch(table, rows[some], texts(top[some], n[some], labels))

    return by_block(stream, maker.micros, [*[g.alias(t) for g, t in zip(group, ties)], label.alias("label")], kernel, TEXTS)


TEXTS = f"{WINDOW} long, us long, {VALUE} string"


def text_batch(table: pa.Table, rows: np.ndarray, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers(table, WINDOW)[rows]), pa.array(numbers(table, "us")[rows]), pa.array(values, pa.string())], [WINDOW, "us", VALUE])
