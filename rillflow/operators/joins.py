"""Positional joins: events with events, and windows with windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..events import SEQ, TS, VALUE, EventStream
from ..ordering import numbered
from .windows import WINDOW, Maker, _nested, window_rows

Pair = Callable[[Column, Column], Column]


def _same_key(left: EventStream, right: EventStream) -> tuple[str, ...]:
    if left.key != right.key:
        raise ValueError("streams to join need the same key")
    return left.key


def join_zip(left: EventStream, right: EventStream) -> EventStream:
    """The k-th value of one side with the k-th of the other, as a struct (_1, _2), at the left one's time; as many as the shorter side has."""
    key = _same_key(left, right)
    side = lambda s: numbered(s.data().df, "__at", [SEQ], F.col(SEQ), s.bucket, key)
    a = side(left).select(*key, "__at", TS, F.col(VALUE).alias("_1"))
    b = side(right).select(*key, "__at", F.col(VALUE).alias("_2"))
    rows = a.join(b, [*key, "__at"])
    return left.with_df(rows.select(*key, F.col("__at").alias(SEQ), TS, F.struct("_1", "_2").alias(VALUE)))


def _flat(stream: EventStream, maker: Maker, side: str) -> DataFrame:
    rows = window_rows(stream, maker)
    return rows.select(*stream.key, WINDOW, F.col(TS).alias(f"__ts_{side}"), F.col("at").alias(f"__at_{side}"), F.col(VALUE).alias(f"__v_{side}"))


def join_elements(left: EventStream, right: EventStream, left_maker: Maker, right_maker: Maker, on: Pair, out: Pair) -> EventStream:
    """Windows of both sides by number; within each pair of windows, ``out`` of all pairs of values that ``on`` accepts.

    The window number is an equality key of the join (and so is any equality in ``on``); results stand in order of window, left and
    right place, at the left window's time. Windows that match nothing give nothing.
    """
    key = _same_key(left, right)
    a, b = _flat(left, left_maker, "l"), _flat(right, right_maker, "r")
    x, y = F.col("__v_l"), F.col("__v_r")
    rows = a.join(b, [*key, WINDOW]).where(on(x, y))
    rows = numbered(rows, SEQ, [WINDOW, "__at_l", "__at_r"], F.col(WINDOW), 1024, key)
    return left.with_df(rows.select(*key, SEQ, F.col("__ts_l").alias(TS), out(x, y).alias(VALUE)))


def join_windows(left: EventStream, right: EventStream, left_maker: Maker, right_maker: Maker, out: Pair) -> EventStream:
    """``out`` of the value lists of the k-th windows of both sides."""
    key = _same_key(left, right)
    side = lambda s, m, v: _nested(s, m).select(*key, WINDOW, F.col(TS).alias(f"{v}_ts"), F.transform("__list", lambda e: e[VALUE]).alias(v))
    rows = side(left, left_maker, "__l").join(side(right, right_maker, "__r"), [*key, WINDOW])
    return left.with_df(rows.select(*key, F.col(WINDOW).alias(SEQ), F.col("__l_ts").alias(TS), out(F.col("__l"), F.col("__r")).alias(VALUE)))
