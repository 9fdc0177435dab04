import datetime as dt
import random

import model
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow import EventStream, from_values, retime
from rillflow import operators as op
from rillflow.functions import hashtags, upper_median
from rillflow.operators import ranked

EPOCH = dt.datetime(2020, 1, 1)


def when(ms):
    return None if ms is None else EPOCH + dt.timedelta(milliseconds=ms)


def millis(t):
    return None if t is None else round((t - EPOCH).total_seconds() * 1000)


def make(spark, events, value="bigint", bucket=4):
    s = from_values(spark, [v for _, v in events], value, [when(t) for t, _ in events])
    return EventStream(s.df, (), bucket)


def rows(stream):
    return [(millis(r.ts), r.value) for r in stream.df.orderBy("seq").collect()]


def events(seed, n=23, ordered=True, untimed=True, valueless=True):
    rnd = random.Random(seed)
    times = [rnd.randrange(0, 40) * 250 for _ in range(n)]
    times = sorted(times) if ordered else times
    return [(None if untimed and rnd.random() < 0.15 else t, None if valueless and rnd.random() < 0.2 else rnd.randrange(0, 50)) for t in times]


STREAMS = [events(1), events(2, ordered=False), events(3, n=1), [], [(None, None)], [(5, None), (None, 3), (5, 4)]]


@pytest.mark.parametrize("s", STREAMS)
def test_stateless(spark, s):
    x = make(spark, s)
    assert rows(op.filter_events(x, lambda v: v > 20)) == model.keep(lambda v: v > 20, s)
    assert rows(op.map_values(x, lambda v: v * 2)) == model.transform(lambda v: v * 2, s)
    lists = [(t, None if v is None else list(range(v % 4))) for t, v in s]
    assert rows(op.expand(make(spark, lists, "array<bigint>"))) == model.flat(lists)


def test_filter_drops_null_predicates(spark):
    x = make(spark, [(1, 1), (2, None)])
    assert rows(op.filter_events(x, lambda v: F.lit(None).cast("boolean"))) == [(2, None)]


@pytest.mark.parametrize("s", STREAMS)
def test_folds(spark, s):
    x = make(spark, s)
    assert rows(op.scan(x, "sum")) == model.scan(lambda a, v: a + v, 0, s)
    assert rows(op.scan(x, "count")) == model.scan(lambda a, v: a + 1, 0, s)
    assert rows(op.scan(x, "max")) == model.scan(max, -1, s)
    assert rows(op.scan(x, "min")) == model.scan(min, 99, s)
    assert rows(op.scan_fold(x, lambda a, v: 2 * a + v, 1, T.LongType())) == model.scan(lambda a, v: 2 * a + v, 1, s)
    assert rows(op.filter_acc(x, lambda a, v: v, 7, lambda v, a: v > a)) == model.keep_acc(lambda a, v: v, 7, lambda v, a: v > a, s)
    assert rows(op.steps(x, 20)) == model.keep_acc(lambda a, v: v, 0, lambda v, a: a > 20 and v <= 20, s)
    assert rows(op.record_highs(x)) == model.keep_acc(lambda a, v: v if a is None else max(a, v), None, lambda v, a: a is None or v > a, s)
    assert rows(op.changes(x)) == model.keep_acc(lambda a, v: (v,), None, lambda v, a: a is None or v != a[0], s)
    assert rows(op.sample(x, 3)) == model.keep_acc(lambda a, v: 3 if a == 0 else a - 1, 3, lambda v, a: a == 0, s)


@pytest.mark.parametrize("s", STREAMS)
@pytest.mark.parametrize("n", [1, 3, 9])
def test_count_windows(spark, s, n):
    x = make(spark, s)
    assert rows(op.window(x, op.Sliding(n, block=4))) == model.nested(model.sliding(n, s))
    assert rows(op.window(x, op.Chop(n))) == model.nested(model.chop(n, s))
    assert rows(op.window_aggregate(x, op.Sliding(n, block=4), "sum")) == [(t, sum(v)) for t, v in model.nested(model.sliding(n, s))]
    assert rows(op.window_aggregate(x, op.Chop(n), "max")) == [(t, max(v)) for t, v in model.nested(model.chop(n, s))]


@pytest.mark.parametrize("s", [events(1), events(4, untimed=False), [], [(None, 1)], [(0, 1), (0, 2), (0, None), (5000, 3)]])
@pytest.mark.parametrize("ms", [500, 1700])
def test_time_windows(spark, s, ms):
    x = make(spark, s)
    expected = model.nested(model.sliding_time(ms, s))
    assert rows(op.window(x, op.SlidingTime(ms))) == expected
    assert rows(op.window_aggregate(x, op.SlidingTime(ms), "count")) == [(t, len(v)) for t, v in expected]
    assert rows(op.window_aggregate(x, op.SlidingTime(ms), "max")) == [(t, max(v, default=None)) for t, v in expected]
    assert rows(op.window(x, op.ChopTime(ms))) == model.nested(model.chop_time(ms, s))


@pytest.mark.parametrize("seed", range(3))
def test_late_events_stay_in_the_open_block(spark, seed):
    s = events(seed, ordered=False)
    x = make(spark, s)
    assert rows(op.window(x, op.ChopTime(700))) == model.nested(model.chop_time(700, s))
    assert rows(op.window_aggregate(x, op.ChopTime(700), "count")) == [(t, len(v)) for t, v in model.nested(model.chop_time(700, s))]


@pytest.mark.parametrize("s", STREAMS)
def test_complete_and_reduce(spark, s):
    x = make(spark, s)
    assert rows(op.window(x, op.Complete())) == model.nested(model.complete(s))
    values = [v for _, v in s if v is not None]
    assert op.reduce_stream(x, F.sum).first().value == (sum(values) if values else None)


def test_windows_refuse_no_length(spark):
    for maker in (op.Chop(0), op.ChopTime(0), op.SlidingTime(0)):
        with pytest.raises(ValueError):
            op.window(make(spark, events(1)), maker)


@pytest.mark.parametrize("seed", range(4))
def test_joins(spark, seed):
    a, b = events(seed), events(seed + 10, n=17)
    x, y = make(spark, a), make(spark, b)
    assert [(t, tuple(v)) for t, v in rows(op.join_zip(x, y))] == model.zipped(a, b)
    left, right = model.nested(model.chop(4, a)), model.nested(model.chop(3, b))
    pairs = [(t, u - v) for (t, us), (_, vs) in zip(left, right) for u in us for v in vs if u < v]
    assert rows(op.join_elements(x, y, op.Chop(4), op.Chop(3), lambda p, q: p < q, lambda p, q: p - q)) == pairs
    sizes = [(t, len(us) * 100 + len(vs)) for (t, us), (_, vs) in zip(left, right)]
    assert rows(op.join_windows(x, y, op.Chop(4), op.Chop(3), lambda p, q: F.size(p) * 100 + F.size(q))) == sizes


@pytest.mark.parametrize("seed", range(3))
def test_merge(spark, seed):
    parts = [events(seed * 3 + k, n=9 + k) for k in range(3)]
    assert rows(op.merge_exact([make(spark, p) for p in parts])) == model.merged(parts)
    timed = [events(seed * 3 + k, n=9 + k, untimed=False) for k in range(3)]
    whole = sorted(((t, k, i, v) for k, p in enumerate(timed) for i, (t, v) in enumerate(p)), key=lambda e: e[:3])
    assert rows(op.merge([make(spark, p) for p in timed], span_us=2_000_000)) == [(t, v) for t, _, _, v in whole]


def test_merge_interleaves_untimed(spark):
    a, b = [(None, v) for v in (1, 2, 3)], [(None, v) for v in (10, 20, 30)]
    assert rows(op.merge([make(spark, a), make(spark, b)])) == model.merged([a, b]) == [(None, v) for v in (1, 10, 2, 20, 3, 30)]


def test_keyed_streams_are_independent(spark):
    s = events(5, n=30, untimed=False, valueless=False)
    df = make(spark, s).df.withColumn("k", F.when(F.col("seq") % 3 < 2, F.col("seq") % 3))
    x = EventStream(df, ("k",), 4)
    for scanned in (op.scan(x, "sum"), op.scan_fold(x, lambda a, v: a + v, 0, T.LongType())):
        for k in (0, 1, None):
            own = [e for i, e in enumerate(s) if (i % 3 if i % 3 < 2 else None) == k]
            got = [(millis(r.ts), r.value) for r in scanned.df.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("seq").collect()]
            assert got == model.scan(lambda a, v: a + v, 0, own)


def test_sessions_and_retime(spark):
    s = [(0, 1), (1000, 2), (5000, 3), (5500, 4), (20000, 5)]
    got = [r.session for r in op.sessions(make(spark, s), 4000).orderBy("seq").collect()]
    assert got == [1, 1, 1, 1, 2]
    moved = retime(make(spark, [(None, 3), (7, None)]), F.timestamp_seconds(F.col("value")))
    assert [r.ts for r in moved.df.orderBy("seq").collect()] == [dt.datetime(1970, 1, 1, 0, 0, 3), when(7)]


def test_map_cache_and_functions(spark):
    s = [(0, 4), (1, None), (2, 4), (3, 5)]
    assert rows(op.map_cache(make(spark, s), lambda v: v * v)) == model.transform(lambda v: v * v, s)
    one = spark.range(1)
    assert one.select(upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)))).first()[0] == 3
    assert one.select(hashtags(F.lit(" #a b #c"))).first()[0] == ["#a", "#c"]


def test_stream_graph(spark):
    s = [(0, 2), (1, None), (2, 3)]
    got = rows(op.stream_graph(make(spark, s), lambda v: F.array(v, v + 1)))
    assert got == model.flat(model.transform(lambda v: [v, v + 1], s))


def test_chop_time_over_a_long_gap(spark, monkeypatch):
    """Empty windows are made span by span."""
    from rillflow import EventStream
    from rillflow.operators import ChopTime, window_aggregate
    from rillflow.operators import windows as w

    df = spark.createDataFrame([(0, 0.0, 1), (1, 0.01, 2), (2, 9.995, 3)], "seq bigint, t double, v bigint").selectExpr("seq", "timestamp_micros(cast(t * 1000000 as bigint)) AS ts", "v")
    stream = EventStream.of(df, "seq", "v", "ts")
    monkeypatch.setattr(w, "SPAN", 64)
    got = {r.seq: r.value for r in window_aggregate(stream, ChopTime(10), "count").df.collect()}
    assert set(got) == set(range(1000)) and {k: n for k, n in got.items() if n} == {0: 1, 1: 1, 999: 1}
    years = EventStream.of(spark.sql("SELECT * FROM VALUES (0L, timestamp'2010-01-01', 1), (1L, timestamp'2014-01-01', 1) AS t(seq, ts, v)"), "seq", "v", "ts")
    monkeypatch.setattr(w, "SPAN", 1 << 16)
    assert window_aggregate(years, ChopTime(10_000), "count").df.count() == 4 * 365 * 8640 + 8640 + 1


REPEATED = [(t, 10 * copy + i) for copy in range(3) for i, t in enumerate((0, 250, 250, 900, 1700, 4000))]


def by_time(ms, s):
    return [(t, [v for u, v in s if t <= u < t + ms and v is not None]) for t, _ in s]


@pytest.mark.parametrize("s", [REPEATED, events(4, untimed=False), [(0, 1), (0, None), (0, 2)]])
def test_time_windows_with_peers(spark, s):
    """Windows by time alone: copies of a table, one after the other."""
    x, maker = make(spark, s), op.SlidingTime(700, peers=True)
    expected = by_time(700, s)
    assert [(t, sorted(v)) for t, v in rows(op.window(x, maker))] == [(t, sorted(v)) for t, v in expected]
    assert rows(op.window_aggregate(x, maker, "count")) == [(t, len(v)) for t, v in expected]
    assert rows(op.window_aggregate(x, maker, "sum")) == [(t, sum(v) if v else None) for t, v in expected]
    for name, of in (("min", min), ("max", max)):
        assert rows(op.window_aggregate(x, maker, name)) == [(t, of(v, default=None)) for t, v in expected]


REPEATED_QUERIES = ["window_sliding_time", "window_sliding_time_max", "topk_window", "taxi_q1", "taxi_q2"]


@pytest.mark.parametrize("name", REPEATED_QUERIES)
def test_queries_on_a_repeated_table(spark, tmp_path, name):
    """Copies with shifted keys and the same times: ties, and times that fall along ``seq``. Rows as SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    from rillflow.queries import ORACLES, QUERIES

    c, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    c.execute(f"""COPY (SELECT event_id + 500 * k AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(event_id AS BIGINT) * (37 + event_id % 3) * 1000000) AS ts, (event_id * 7) % 23 AS user_id,
      ['click', 'view', 'purchase', 'signup'][1 + event_id * event_id % 4] AS event_type, (event_id * 131 % 9973) / 100.0 AS value FROM range(500) t(event_id), range(3) u(k)) TO '{path}'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_dominance_against_brute_force():
    """Ties in place and time, several widths of windows, signed weights."""
    import numpy as np

    from rillflow.operators.ranked import dominance

    rnd = np.random.default_rng(1)
    for points, windows, top in ((0, 3, 9), (700, 500, 40), (900, 300, 5), (400, 400, 1), (20, 500, 10_000)):
        at, below, place, until = (rnd.integers(0, top, n) for n in (points, points, windows, windows))
        weight, code = rnd.integers(-1, 2, points).astype(float), rnd.integers(0, 6, points)
        want = np.zeros((windows, 6), int)
        for w in range(windows):
            np.add.at(want[w], code[(at >= place[w]) & (below < until[w])], weight[(at >= place[w]) & (below < until[w])].astype(int))
        got = np.full((windows, 6), -99)
        for q, sums in dominance(at, below, weight, code, 6, place, until):
            got[q] = sums
        assert (got == want).all()


def test_top_counts_ties_and_missing_groups(spark):
    """Fewer groups than asked for, equal counts by value, events without a value or a time."""
    s = [(0, "b"), (0, None), (100, "a"), (None, "a"), (200, "b"), (650, "c"), (9000, None), (20000, "a")]
    out = ranked.top_counts(make(spark, s, "string"), op.SlidingTime(500), 2)
    got = [(r.window_id, r.rank, r.value, r.n) for r in out.orderBy("window_id", "rank").collect()]
    timed = [e for e in s if e[0] is not None]
    want = []
    for i, held in enumerate(model.sliding_time(500, timed)):
        values = [v for _, v in held if v is not None]
        want += [(i, k + 1, v, values.count(v)) for k, v in enumerate(sorted(set(values), key=lambda v: (-values.count(v), v))[:2])]
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_profitable_cells(spark, seed, monkeypatch):
    """Few taxis, drop-offs other than event times, times that do not rise, pairs looked at one by one."""
    from rillflow.apps import taxi

    rnd = random.Random(seed)
    at = [rnd.randrange(0, 3_000) for _ in range(60)]
    at = sorted(at) if seed == 0 else at
    trips = [(i, t, rnd.randrange(0, 4), rnd.randrange(1, 3), rnd.randrange(4), (t - rnd.randrange(500)) * 1000, (t + rnd.randrange(-300, 300)) * 1000, rnd.randrange(9), rnd.randrange(9)) for i, t in enumerate(at)]
    fields = "named_struct('start', a, 'end', b, 'medallion', m, 'pickup', p, 'dropoff', d, 'fare', f, 'tip', g)"
    df = spark.createDataFrame(trips, "seq bigint, ms bigint, a bigint, b bigint, m bigint, p bigint, d bigint, f bigint, g bigint").selectExpr("seq", "timestamp_millis(ms) AS ts", f"{fields} AS value")
    monkeypatch.setattr(taxi, "PAIRS", 7)
    got = [(r.seq, r.value) for r in taxi.profitable_cells(EventStream(df), 3, 2, 2, 400, 800).df.orderBy("seq").collect()]
    kept = [t for t in trips if 1 <= t[2] <= 3 and 1 <= t[3] <= 2]
    want, before = [], None
    for i, a in enumerate(kept):
        held = lambda ms: [b for b in kept[i:] if a[1] // ms * ms <= b[1] < a[1] + ms]
        rates = []
        for cell in (1, 2, 3):
            there, paid = [b for b in held(800) if b[2] == cell], sorted(b[7] + b[8] for b in held(400) if b[2] == cell)
            n = sum(max(c[5] for c in there if c[4] == b[4]) < b[6] for b in there)
            if n:
                rates.append((cell, int((paid[len(paid) // 2] if paid else 0) * 1000.0 // n)))
        value = ",".join(f"{c}:{r}" for c, r in sorted(rates, key=lambda x: (-x[1], x[0]))[:2])
        if value != before:
            want.append((i, value))
        before = value
    assert got == want
