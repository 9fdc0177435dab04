"""Operators on live streams.

Filters, maps and merges of the batch operators that need no order work on streaming DataFrames as they are. What needs order or
state runs here as a stateful processor for each key: rows go by ``seq`` within a micro-batch, and state carries over to the next.
Order across micro-batches is that of arrival. The state store must be RocksDB (``running.configure`` sets it).

Windows are emitted when they are full: ``chop`` after its n-th value, ``chop_time`` when a later block begins, ``sliding`` when the
value n - 1 places on has come, ``sliding_time`` when an event has come that is too late for the window. What is open at the end of
a stream stays open. A window's aggregate is a map of its list. An event that comes late is taken where it comes.

Rows reach the functions as Python values: integers are exact, NaN is a value, structs are dictionaries. A key's state is read and
written once in a micro-batch; it is what the operator must remember, so a window's values at most. Without a key, all is one task.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..events import SEQ, TS, VALUE, EventStream, micros

_KEY = "__key"
#: (seq, time in microseconds, value) of an event.
Event = tuple[int, Any, Any]
Step = Callable[[Any, tuple], tuple[Any, list[Event]]]


class _Ordered(StatefulProcessor):
    """Runs ``step(state, (seq, ts, value, *rest)) -> (state, rows out)`` over a key's rows in order."""

    def __init__(self, start: Callable[[], Any], step: Step, columns: list[str], keys: list[str]):
        self.start, self.step, self.columns, self.keys = start, step, columns, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", T.StructType([T.StructField("bytes", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = pickle.loads(self.held.get()[0]) if self.held.exists() else self.start()
        mine = sorted((tuple(row[c] for c in self.columns) for row in rows), key=lambda r: r[0])
        named = dict(zip(self.keys, key, strict=True))
        for row in mine:
            state, new = self.step(state, row)
            for seq, ts, value in new:
                yield Row(**named, **{SEQ: seq, TS: ts, VALUE: value})
        self.held.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: tuple[str, ...], start: Callable[[], Any], step: Step, out: T.DataType, columns: list[str]) -> DataFrame:
    """Rows in order of the first of the columns. Times are microseconds inside, so no time zone matters."""
    keys = list(key) or [_KEY]
    rows = (df if key else df.withColumn(_KEY, F.lit(0))).withColumn(TS, micros())
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(SEQ, T.LongType()), T.StructField(TS, T.LongType()), T.StructField(VALUE, out)])
    done = rows.groupBy(*keys).transformWithState(_Ordered(start, step, columns, keys), schema, "Append", "None")
    return done.select(*key, SEQ, F.timestamp_micros(TS).alias(TS), VALUE)


def _ordered(stream: EventStream, start: Callable[[], Any], step: Step, out: T.DataType) -> EventStream:
    return stream.with_df(_run(stream.df, stream.key, start, step, out, [SEQ, TS, VALUE]))


def live_scan(stream: EventStream, f: Callable[[Any, Any], Any], initial: Any, out: T.DataType) -> EventStream:
    """After each value, the new accumulator; events without a value pass."""

    def step(acc, row):
        seq, ts, v = row
        if v is None:
            return acc, [row]
        acc = f(acc, v)
        return acc, [(seq, ts, acc)]

    return _ordered(stream, lambda: initial, step, out)


def live_filter_acc(stream: EventStream, f: Callable[[Any, Any], Any], initial: Any, keep: Callable[[Any, Any], bool]) -> EventStream:
    """Stateful filter: the test sees the old accumulator, which always advances."""

    def step(acc, row):
        if row[2] is None:
            return acc, [row]
        return f(acc, row[2]), [row] if keep(row[2], acc) else []

    return _ordered(stream, lambda: initial, step, stream.value_type)


def live_chop(stream: EventStream, n: int) -> EventStream:
    """Lists of ``n`` consecutive values."""

    def step(state, row):
        count, ts, held = state
        if row[2] is None:
            return state, []
        ts = ts if held else row[1]
        held.append(row[2])
        return ((count + 1, None, []), [(count, ts, held)]) if len(held) == n else ((count, ts, held), [])

    return _ordered(stream, lambda: (0, None, []), step, T.ArrayType(stream.value_type))


def live_sliding(stream: EventStream, n: int) -> EventStream:
    """For each value, it and the ``n - 1`` after it, once those have come."""

    def step(state, row):
        count, held = state
        if row[2] is None:
            return state, []
        held.append(row)
        if len(held) < n:
            return state, []
        out = (count, held[0][1], [r[2] for r in held])
        held.popleft()
        return (count + 1, held), [out]

    return _ordered(stream, lambda: (0, deque()), step, T.ArrayType(stream.value_type))


def live_sliding_time(stream: EventStream, ms: int) -> EventStream:
    """For each timed event, the values of it and of those after it that are less than ``ms`` milliseconds later, once a later one has come."""

    def step(state, row):
        count, held = state
        if row[1] is None:
            return state, []
        out = []
        while held and row[1] - held[0][1] >= ms * 1000:
            out.append((count, held[0][1], [r[2] for r in held if r[2] is not None]))
            held.popleft()
            count += 1
        held.append(row)
        return (count, held), out

    return _ordered(stream, lambda: (0, deque()), step, T.ArrayType(stream.value_type))


def live_chop_time(stream: EventStream, ms: int) -> EventStream:
    """Blocks of ``ms`` milliseconds from the first timed event on, empty ones included; late events fall in the open block."""

    def step(state, row):
        at = row[1]
        if at is None:
            return state, []
        first, block, ts, held = state or (at, 0, at, [])
        now = max(block, (at - first) // (ms * 1000))
        out = []
        if now > block:
            out = [(block, ts, held), *[(k, None, []) for k in range(block + 1, now)]]
            block, ts, held = now, at, []
        if row[2] is not None:
            held.append(row[2])
        return (first, block, ts, held), out

    return _ordered(stream, lambda: None, step, T.ArrayType(stream.value_type))


def live_sessions(stream: EventStream, gap_ms: int) -> EventStream:
    """Timed events with a value (session, start, value): their session, counted from 1, and when it began. A gap of more than ``gap_ms`` ends one."""
    kind = T.StructType([T.StructField("session", T.LongType()), T.StructField("start", T.LongType()), T.StructField("value", stream.value_type)])

    def step(state, row):
        seq, at, v = row
        if at is None:
            return state, []
        session, start, last = state or (0, None, None)
        if last is None or at - last > gap_ms * 1000:
            session, start = session + 1, at
        return (session, start, at), [(seq, at, {"session": session, "start": start, "value": v})]

    out = _ordered(stream, lambda: None, step, kind)
    of = F.struct(F.col(VALUE)["session"].alias("session"), F.timestamp_micros(F.col(VALUE)["start"]).alias("start"), F.col(VALUE)["value"].alias("value"))
    return out.with_df(out.df.withColumn(VALUE, of))


def live_expand(stream: EventStream, most: int = 1 << 20) -> EventStream:
    """An event for each element of a list; ``seq`` is the list's times ``most`` plus the element's place. Stateless.

    A list of more than ``most`` elements is an error, as its events would take the numbers of the next list's.
    """
    v = F.col(VALUE)
    some = F.when(v.isNull(), F.array(F.lit(None).cast(stream.value_type.elementType))).when(F.size(v) <= most, v)
    some = some.otherwise(F.raise_error(F.lit(f"a list has more than {most} elements")))
    rows = stream.df.select(*stream.key, F.col(SEQ).alias("__outer"), TS, F.posexplode(some).alias("__inner", VALUE))
    return stream.with_df(rows.select(*stream.key, (F.col("__outer") * most + F.col("__inner")).alias(SEQ), TS, VALUE))


def _sides(streams: list[EventStream], values: bool) -> tuple[DataFrame, list[str]]:
    """The streams' rows with ``side`` and a column v0, v1, ... for each stream's value."""
    rows = None
    for k, s in enumerate(streams):
        own = [F.col(VALUE) if j == k else F.lit(None).cast(t.value_type) for j, t in enumerate(streams)]
        part = (s.data() if values else s).df.select(*s.key, SEQ, TS, F.lit(k).alias("side"), *[c.alias(f"v{j}") for j, c in enumerate(own)])
        rows = part if rows is None else rows.unionByName(part)
    return rows, [SEQ, TS, "side", *[f"v{j}" for j in range(len(streams))]]


def live_zip(left: EventStream, right: EventStream) -> EventStream:
    """The k-th value of one side with the k-th of the other, as soon as both have come."""
    both, columns = _sides([left, right], True)

    def step(state, row):
        count, waiting = state
        seq, ts, k, *values = row
        waiting[k].append((ts, values[k]))
        if not waiting[1 - k]:
            return state, []
        (at, a), (_, b) = waiting[0].popleft(), waiting[1].popleft()
        return (count + 1, waiting), [(count, at, {"_1": a, "_2": b})]

    pair = T.StructType([T.StructField("_1", left.value_type), T.StructField("_2", right.value_type)])
    return left.with_df(_run(both, left.key, lambda: (0, (deque(), deque())), step, pair, columns))


def live_merge(streams: list[EventStream]) -> EventStream:
    """The streams' events in order of time, then of the stream's number: the earliest head goes once every stream has one waiting.

    Times must rise within each stream; of heads, those without a time go first.
    """
    rows, columns = _sides(streams, False)
    n = len(streams)

    def step(state, row):
        count, waiting = state
        _, ts, k, *values = row
        waiting[k].append((ts is not None, ts or 0, k, ts, values[k]))
        out = []
        while all(waiting):
            first = min(range(n), key=lambda j: waiting[j][0][:3])
            *_, at, v = waiting[first].popleft()
            out.append((count, at, v))
            count += 1
        return (count, waiting), out

    return streams[0].with_df(_run(rows, streams[0].key, lambda: (0, [deque() for _ in range(n)]), step, streams[0].value_type, columns))


Windows = Callable[[EventStream], EventStream]


def live_join_windows(left: EventStream, right: EventStream, left_windows: Windows, right_windows: Windows, out: Callable[[Column, Column], Column]) -> EventStream:
    """``out`` of the lists of the k-th windows of both sides, as soon as both are full."""
    pairs = live_zip(left_windows(left), right_windows(right))
    return pairs.with_df(pairs.df.withColumn(VALUE, out(F.col(VALUE)["_1"], F.col(VALUE)["_2"])))


def live_join_elements(left: EventStream, right: EventStream, left_windows: Windows, right_windows: Windows, on: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> EventStream:
    """Within the k-th windows of both sides, ``out`` of all pairs of values that ``on`` accepts, in order; numbered as by ``live_expand``."""

    def matches(x: Column, y: Column) -> Column:
        return F.flatten(F.transform(x, lambda a: F.transform(F.filter(y, lambda b: on(a, b)), lambda b: out(a, b))))

    return live_expand(live_join_windows(left, right, left_windows, right_windows, matches))
