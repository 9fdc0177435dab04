"""Taxi programs: frequent routes, and profitable areas.

A trip is a value of fields (start, end, pickup, dropoff, medallion, fare, tip): cells, micros, and amounts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..events import EventStream
from ..functions import in_grid, profit
from ..operators import changes, filter_events, map_values
from ..operators.ranked import ABSENT, TEXTS, by_block, coded, dominance, leading, numbers, text_batch, texts, top_texts
from ..operators.windows import WINDOW, SlidingTime

#: Pairs of a trip and another, or of a trip and a window, that are looked at a time.
PAIRS = 1 << 20


def in_range(trip: Column, starts: int, ends: int) -> Column:
    return in_grid(trip["start"], starts) & in_grid(trip["end"], ends)


def _micros(trips: EventStream, field: str) -> Column:
    """A time of a trip in microseconds, whether it is given so or as a timestamp."""
    time = F.col("value")[field]
    return F.unix_micros(time) if isinstance(trips.value_type[field].dataType, T.TimestampType) else time.cast("long")


def _empty(taxi: np.ndarray, place: np.ndarray, us: np.ndarray, pick: np.ndarray, drop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Signed points (trip, place, time, weight) whose sum over a window is 1 for each of its trips that leaves an empty taxi, else 0.

    A trip counts from its own point on. Trips of the taxi there that were picked up at its drop-off or later end that: for windows
    that reach the first of them at ``place`` or later. Those at rising places, by time, make steps, each with a point to end and
    one to begin.
    """
    yield np.arange(len(us)), place, us, np.ones(len(us))
    ranks = np.unique(np.concatenate([pick, drop]))
    n = len(ranks) + 1
    key = taxi * n + np.searchsorted(ranks, pick)
    order = np.argsort(key, kind="stable")
    lo = np.searchsorted(key[order], taxi * n + np.searchsorted(ranks, drop))
    found = np.searchsorted(key[order], (taxi + 1) * n) - lo
    base = place.min()
    far = place.max() - base + 2
    upto = np.cumsum(found)
    begin = 0
    while begin < len(us):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        of = np.repeat(np.arange(begin, end), found[begin:end])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(found[begin:end]) - found[begin:end], found[begin:end])
        later = order[lo[of] + nth]
        at = np.maximum(us[later], us[of])
        by = np.lexsort((at, of))
        of, later, at = of[by], later[by], at[by]
        reach = np.maximum.accumulate((of - begin) * far + place[later] - base + 1) - (of - begin) * far
        before = np.where(np.diff(of, prepend=-1) == 0, np.concatenate([[0], reach[:-1]]), 0)
        own = place[of] - base + 1
        step = (reach > before) & (before < own)
        yield of[step], np.minimum(reach, own)[step] + base - 1, at[step], -np.ones(step.sum())
        step &= before > 0
        yield of[step], before[step] + base - 1, at[step], np.ones(step.sum())
        begin = end


def _medians(amounts: np.ndarray, code: np.ndarray, codes: int, place: np.ndarray, us: np.ndarray, of: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each window and code, the upper median of amounts at ``of`` or later, from ``since`` on and before ``until``; 0 if there is none."""
    out = np.zeros((len(of), codes))
    order = np.lexsort((amounts, code))
    order = order[(place[order] >= of.min()) & (us[order] >= since.min()) & (us[order] < until.max())]
    cuts = np.searchsorted(code[order], np.arange(codes + 1))
    for c in range(codes):
        some = order[cuts[c] : cuts[c + 1]]
        if not len(some):
            continue
        wide = max(1, PAIRS // len(some))
        for lo in range(0, len(of), wide):
            w = slice(lo, lo + wide)
            held = (place[some] >= of[w, None]) & (us[some] >= since[w, None]) & (us[some] < until[w, None])
            upto = held.cumsum(axis=1, dtype=np.int32)
            n = upto[:, -1]
            middle = np.minimum((upto <= (n // 2)[:, None]).sum(axis=1), len(some) - 1)
            out[w, c] = np.where(n > 0, amounts[some][middle], 0)
    return out


def frequent_routes(trips: EventStream, starts: int, ends: int, k: int = 10, ms: int = 1_800_000, journey_identity: bool = False) -> EventStream:
    """The ``k`` most frequent routes of the half hour from each trip on, where they differ from the trip before.

    A route is (start, end); with ``journey_identity``, trips count as equal only if their times are too.
    """
    kept = filter_events(trips, lambda t: in_range(t, starts, ends))
    route = ["start", "end", *(["pickup", "dropoff"] if journey_identity else [])]
    lists = top_texts(kept, SlidingTime(ms), k, [F.col("value")[c] for c in route]).localCheckpoint(eager=False)
    return changes(kept.with_df(lists.select(F.col(WINDOW).alias("seq"), F.timestamp_micros("us").alias("ts"), "value")))


def profitable_cells(trips: EventStream, starts: int, ends: int, k: int = 10, profit_ms: int = 900_000, empty_ms: int = 1_800_000) -> EventStream:
    """The ``k`` most profitable start cells, where they differ from the trip before.

    Profitability: the upper median of earnings in the quarter hour from each trip on (0 if there is none), divided by the number of empty
    taxis in its half hour, in thousandths. A taxi counts as empty where it started, if it was not picked up there after it was last dropped off.
    """
    kept = filter_events(trips, lambda t: in_range(t, starts, ends))
    value = F.col("value")
    earned, missing = profit(value["fare"], value["tip"]).cast("double"), F.lit(-(1 << 62))
    times = [F.coalesce(_micros(trips, "pickup"), missing).alias("pick"), F.coalesce(_micros(trips, "dropoff"), missing).alias("drop")]
    columns = [value["start"].alias("start"), value["medallion"].alias("medallion"), *times, earned.alias("earned")]
    profit_us, empty_us = SlidingTime(profit_ms).micros, SlidingTime(empty_ms).micros

    def kernel(table):
        place, us, earned, own, has = (numbers(table, n) for n in (WINDOW, "us", "earned", "own", "has"))
        own, has = np.flatnonzero(own), np.flatnonzero(has)
        if not len(own) or not len(has):
            return
        trips = table.take(pa.array(has))
        cell, first = coded([trips.column("start")])
        taxi, _ = coded([trips.column("start"), trips.column("medallion")])
        labels = [f"{c}:" for c in trips.column("start").take(pa.array(first)).to_pylist()]
        cells, at, when = len(first), place[has], us[has]
        points = list(_empty(taxi, at, when, numbers(trips, "pick"), numbers(trips, "drop")))
        of, high, low, weight = (np.concatenate(p) for p in zip(*points))
        # one more code: all trips of a window
        code, weight = np.concatenate([cell[of], np.full(len(has), cells)]), np.concatenate([weight, np.ones(len(has))])
        high, low = np.concatenate([high, at]), np.concatenate([low, when]) - empty_us
        paid = np.flatnonzero(~np.isnan(earned[has]))
        for q, counts in dominance(high, low, weight, code, cells + 1, place[own], us[own]):
            rows = own[q]
            q_us, n = us[rows], counts[:, :-1]
            since = np.floor_divide(q_us, profit_us) * profit_us
            middle = _medians(earned[has][paid], cell[paid], cells, at[paid], when[paid], place[rows], since, q_us + profit_us)
            rate = np.floor(middle * 1000.0 / np.maximum(n, 1)).astype(np.int64)
            top, amounts = leading(np.where(n > 0, rate, ABSENT), k)
            some = counts[:, -1] > 0
            yield text_batch(table, rows[some], texts(top[some], amounts[some], labels))

    lists = by_block(kept, max(profit_us, empty_us), columns, kernel, TEXTS).localCheckpoint(eager=False)
    return changes(kept.with_df(lists.select(F.col(WINDOW).alias("seq"), F.timestamp_micros("us").alias("ts"), "value")))


def trips_of(stream: EventStream, start: Column, end: Column, pickup: Column, dropoff: Column, medallion: Column, fare: Column, tip: Column) -> EventStream:
    """Trips made of an event's fields."""
    fields = {"start": start, "end": end, "pickup": pickup, "dropoff": dropoff, "medallion": medallion, "fare": fare, "tip": tip}
    return map_values(stream, lambda v: F.struct(*[c.alias(n) for n, c in fields.items()]))
