"""Windows over event streams: makers, and two representations.

Flat: a row for each event and window it is in (``window_rows``), for aggregates and joins. Nested: an event per window whose value
is the list of its values (``window``). A window's time is that of its first event. Windows of disjoint makers are found by positions
or times and grouped; overlapping ones are frames within blocks that repeat the few events that a window reaches beyond its block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..events import SEQ, TS, VALUE, EventStream, micros
from ..ordering import ahead, numbered, running

WINDOW = "window_id"
Aggregate = str | Callable[[Column], Column]
#: Named aggregates of a window; anything else is a function of the list of its values.
NAMED: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


#: Window ids that are made at a time.
SPAN = 1 << 16


def _positive(n: int, what: str) -> int:
    if n < 1:
        raise ValueError(f"{what} must be at least 1")
    return n


@dataclass(frozen=True)
class Chop:
    """Consecutive blocks of ``n`` values; the last may be shorter."""

    n: int
    value_independent = True

    def rows(self, stream: EventStream) -> DataFrame:
        _positive(self.n, "the window's length")
        rows = numbered(stream.data().df, "__at", [SEQ], F.col(SEQ), stream.bucket, stream.key)
        return rows.withColumn(WINDOW, F.floor(F.col("__at") / self.n).cast("long")).drop("__at")


@dataclass(frozen=True)
class ChopTime:
    """Blocks of ``ms`` milliseconds from the first timed event on; a late event falls in the block open when it comes.

    Blocks without events are windows as well: empty lists without a time. With ``ordered``, times are known to rise
    with ``seq``, and no running maximum is needed.
    """

    ms: int
    ordered: bool = False
    value_independent = True

    def rows(self, stream: EventStream) -> DataFrame:
        span = _positive(self.ms, "the window's length") * 1000
        timed = stream.timed().df
        first = timed.groupBy(*stream.key).agg(F.min_by(micros(), SEQ).alias("__t0")) if stream.key else timed.agg(F.min_by(micros(), SEQ).alias("__t0"))
        rows = timed.join(first, list(stream.key)) if stream.key else timed.join(F.broadcast(first))
        rows = rows.withColumn("__k", F.floor((micros() - F.col("__t0")) / F.lit(span)).cast("long"))
        if self.ordered:
            return rows.withColumnRenamed("__k", WINDOW).drop("__t0")
        rows = running(rows, "__far", F.max, F.col("__k"), F.greatest, [SEQ], F.col(SEQ), stream.bucket, stream.key)
        return rows.withColumn(WINDOW, F.greatest(F.col("__far"), F.lit(0).cast("long"))).drop("__t0", "__k", "__far")

    def gaps(self, stream: EventStream, found: DataFrame) -> DataFrame:
        """All window ids, from 0 to the last one found."""
        last = found.groupBy(*stream.key).agg(F.max(WINDOW).alias("__last")) if stream.key else found.agg(F.max(WINDOW).alias("__last"))
        zero = F.lit(0).cast("long")
        spans = last.where("__last is not null").withColumn("__span", F.explode(F.sequence(zero, F.floor(F.col("__last") / SPAN).cast("long"))))
        spans = spans.repartition(*stream.key, "__span")  # a long gap is many spans, and so many tasks
        start = F.col("__span") * SPAN
        return spans.select(*stream.key, F.explode(F.sequence(start, F.least(F.col("__last"), start + (SPAN - 1)))).alias(WINDOW))


@dataclass(frozen=True)
class Complete:
    """One window with everything."""

    value_independent = True

    def rows(self, stream: EventStream) -> DataFrame:
        return stream.df.withColumn(WINDOW, F.lit(0).cast("long"))


@dataclass(frozen=True)
class Sliding:
    """For each value, it and the ``n - 1`` after it; shorter at the end."""

    n: int
    block: int = 1 << 18
    value_independent = True

    def framed(self, stream: EventStream) -> tuple[DataFrame, object]:
        rows = numbered(stream.data().df, WINDOW, [SEQ], F.col(SEQ), stream.bucket, stream.key)
        rows = ahead(rows, WINDOW, max(1, self.n), self.block)
        frame = Window.partitionBy(*stream.key, "__block").orderBy(WINDOW).rowsBetween(0, max(0, self.n - 1))
        return rows, frame


@dataclass(frozen=True)
class SlidingTime:
    """For each timed event, it and those after it up to the first that is ``ms`` milliseconds later or more; times must rise with ``seq``.

    With ``peers`` windows go by time alone, as a RANGE frame of SQL does: all events of the event's own time and after it, wherever
    they stand in ``seq``.
    """

    ms: int
    peers: bool = False
    value_independent = True

    @property
    def micros(self) -> int:
        return _positive(self.ms, "the window's length") * 1000

    def framed(self, stream: EventStream) -> tuple[DataFrame, object]:
        span = self.micros
        rows = numbered(stream.timed().df, WINDOW, [SEQ], F.col(SEQ), stream.bucket, stream.key).withColumn("__us", micros())
        own = F.floor(F.col("__us") / F.lit(span)).cast("long")
        rows = rows.withColumn("__own", own).withColumn("__block", F.explode(F.array(F.col("__own"), F.col("__own") - 1)))
        rows = rows.withColumn("__halo", F.col("__own") != F.col("__block")).drop("__own")
        return rows, Window.partitionBy(*stream.key, "__block").orderBy("__us").rangeBetween(0, span - 1)


@dataclass(frozen=True)
class Custom:
    """Any assignment of rows to windows: a function from the stream to its rows with ``window_id`` (bigint, in order)."""

    assign: Callable[[EventStream], DataFrame]
    value_independent = False

    def rows(self, stream: EventStream) -> DataFrame:
        return self.assign(stream)


Maker = Chop | ChopTime | Complete | Sliding | SlidingTime | Custom


def _listed(rows: DataFrame, stream: EventStream) -> DataFrame:
    """A row for each window: its time and its (seq, value) structs in order."""
    held = F.array_sort(F.collect_list(F.when(F.col(VALUE).isNotNull(), F.struct(SEQ, VALUE))))
    return rows.groupBy(*stream.key, WINDOW).agg(F.min_by(TS, SEQ).alias(TS), held.alias("__list"))


def _nested(stream: EventStream, maker: Maker) -> DataFrame:
    """(key, window_id, ts, __list of (seq, value)) of each window."""
    if isinstance(maker, (Sliding, SlidingTime)):
        rows, frame = maker.framed(stream)
        held = F.collect_list(F.struct(SEQ, VALUE)).over(frame)
        rows = rows.withColumn("__list", held).where("not __halo")
        peers = isinstance(maker, SlidingTime) and maker.peers
        mine = F.filter("__list", lambda e: e[VALUE].isNotNull() if peers else (e[SEQ] >= F.col(SEQ)) & e[VALUE].isNotNull())
        if isinstance(maker, Sliding) and maker.n < 1:
            mine = F.slice("__list", 1, 0)
        return rows.select(*stream.key, WINDOW, TS, F.array_sort(mine).alias("__list"))
    out = _listed(maker.rows(stream), stream)
    if isinstance(maker, ChopTime):
        out = maker.gaps(stream, out).join(out, [*stream.key, WINDOW], "left")
    if isinstance(maker, Complete) and not stream.key:
        one = stream.df.sparkSession.range(1).select(F.lit(0).cast("long").alias(WINDOW))
        out = one.join(out, WINDOW, "left")
    empty = F.array().cast(out.schema["__list"].dataType)
    return out.withColumn("__list", F.coalesce("__list", empty))


def window(stream: EventStream, maker: Maker) -> EventStream:
    """An event for each window, with the list of its values; ``seq`` counts windows."""
    rows = _nested(stream, maker)
    values = F.transform("__list", lambda e: e[VALUE])
    return stream.with_df(rows.select(*stream.key, F.col(WINDOW).alias(SEQ), TS, values.alias(VALUE)))


def window_rows(stream: EventStream, maker: Maker) -> DataFrame:
    """A row for each value and window it is in: key, window_id, ts (the window's), at (place in the window), value."""
    if isinstance(maker, (Sliding, SlidingTime)):
        rows = _nested(stream, maker)
        rows = rows.select(*stream.key, WINDOW, TS, F.posexplode("__list").alias("at", "__e"))
        return rows.select(*stream.key, WINDOW, TS, F.col("at").cast("long").alias("at"), F.col("__e")[VALUE].alias(VALUE))
    rows = maker.rows(stream)
    first = rows.groupBy(*stream.key, WINDOW).agg(F.min_by(TS, SEQ).alias("__ts"))
    rows = rows.where(F.col(VALUE).isNotNull()).join(first, [*stream.key, WINDOW])
    return rows.select(*stream.key, WINDOW, F.col("__ts").alias(TS), F.col(SEQ).alias("at"), VALUE)


def window_aggregate(stream: EventStream, maker: Maker, aggregate: Aggregate) -> EventStream:
    """The aggregate of each window's values: the name of one of ``NAMED``, or a function of the list.

    Named aggregates are partial sums (disjoint windows) or frames (sliding ones); no list is built. A window of ``SlidingTime`` is the
    rest of its event's block of time and the beginning of the next one: two running aggregates. Of an empty window, count is 0 and
    the others are null.
    """
    if not isinstance(aggregate, str):
        nested = window(stream, maker)
        return stream.with_df(nested.df.withColumn(VALUE, aggregate(F.col(VALUE))))
    named = NAMED[aggregate]
    if isinstance(maker, Sliding) and maker.n >= 1:
        rows, frame = maker.framed(stream)
        rows = rows.withColumn("__agg", named(F.col(VALUE)).over(frame)).where("not __halo")
        return stream.with_df(rows.select(*stream.key, F.col(WINDOW).alias(SEQ), TS, F.col("__agg").alias(VALUE)))
    if isinstance(maker, SlidingTime):
        rows, _ = maker.framed(stream)
        block = Window.partitionBy(*stream.key, "__block")
        back = block.orderBy(F.desc("__us")) if maker.peers else block.orderBy(F.desc("__us"), F.desc(SEQ))
        back = back.rangeBetween(Window.unboundedPreceding, 0) if maker.peers else back.rowsBetween(Window.unboundedPreceding, 0)
        ahead_ = block.orderBy("__us").rangeBetween(Window.unboundedPreceding, maker.micros - 1)
        here = named(F.when(~F.col("__halo"), F.col(VALUE))).over(back)
        beyond = named(F.when(F.col("__halo"), F.col(VALUE))).over(ahead_)
        rows = rows.withColumn("__here", here).withColumn("__beyond", beyond).where("not __halo")
        join = {"min": F.least, "max": F.greatest}.get(aggregate, lambda a, b: F.coalesce(a + b, a, b))
        both = join(F.col("__here"), F.col("__beyond")).alias(VALUE)
        return stream.with_df(rows.select(*stream.key, F.col(WINDOW).alias(SEQ), TS, both))
    if isinstance(maker, Sliding):
        over_list = {"count": lambda v: F.size(v).cast("long"), "sum": lambda v: F.aggregate(v, F.lit(0).cast(stream.value_type), lambda a, x: (a + x).cast(stream.value_type)), "min": F.array_min, "max": F.array_max}
        return window_aggregate(stream, maker, over_list[aggregate])
    rows = maker.rows(stream)
    out = rows.groupBy(*stream.key, WINDOW).agg(F.min_by(TS, SEQ).alias(TS), named(F.col(VALUE)).alias(VALUE))
    if isinstance(maker, ChopTime):
        out = maker.gaps(stream, out).join(out, [*stream.key, WINDOW], "left")
    if isinstance(maker, Complete) and not stream.key:
        out = stream.df.sparkSession.range(1).select(F.lit(0).cast("long").alias(WINDOW)).join(out, WINDOW, "left")
    if aggregate == "count":
        out = out.withColumn(VALUE, F.coalesce(VALUE, F.lit(0).cast("long")))
    return stream.with_df(out.select(*stream.key, F.col(WINDOW).alias(SEQ), TS, VALUE))
