import datetime as dt
import socket as socketlib
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow import EventStream
from rillflow import operators as op
from rillflow.sources import decoded, encoded, from_environment, kafka, live_files, mqtt, read_taxi_csv, read_wearable_csv, read_wearable_raw, tcp, to_environment
from rillflow.apps.wearable import running_sessions
from rillflow.streaming import (
    live_chop,
    live_chop_time,
    live_expand,
    live_filter_acc,
    live_join_elements,
    live_join_windows,
    live_merge,
    live_scan,
    live_sessions,
    live_sliding,
    live_sliding_time,
    live_zip,
    node,
)

SCHEMA = "seq bigint, ts timestamp, value bigint, k string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live") / "in")
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(milliseconds=400 * i), None if i % 5 == 4 else (i * 37) % 23, "ab"[i % 2]) for i in range(20)]
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, folder, tmp_path, program, key=("k",), per_trigger=None, n=1):
    sources = [EventStream(live_files(spark, folder, SCHEMA, per_trigger=per_trigger), key) for _ in range(n)]
    out = str(tmp_path / "out")
    q = node(sources, program, "parquet", checkpoint=str(tmp_path / "cp"), path=out, once=True)
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def batch(spark, folder, program, key=("k",), n=1):
    sources = [EventStream(spark.read.schema(SCHEMA).parquet(folder), key) for _ in range(n)]
    return sorted(tuple(r) for r in program(*sources).df.collect())


def test_stateless_programs_run_unchanged(spark, folder, tmp_path):
    program = lambda s: op.filter_events(op.map_values(s, lambda v: v * 2), lambda v: v > 10)
    live = lambda s: s.with_df(program(s).df.where("value is not null").select("k", "seq", "ts", "value"))
    assert run(spark, folder, tmp_path, live) == batch(spark, folder, live)


def test_live_folds_equal_batch_folds(spark, folder, tmp_path):
    add, new = lambda a, v: int(a + v), lambda v, a: v > a
    clean = lambda s: s.with_df(s.df.where("value is not null"))
    assert run(spark, folder, tmp_path / "a", lambda s: live_scan(clean(s), add, 0, T.LongType())) == batch(spark, folder, lambda s: op.scan_fold(clean(s), add, 0, T.LongType()))
    assert run(spark, folder, tmp_path / "b", lambda s: live_filter_acc(clean(s), lambda a, v: v, 0, new)) == batch(spark, folder, lambda s: op.filter_acc(clean(s), lambda a, v: v, 0, new))


def test_live_windows(spark, folder, tmp_path):
    listed = lambda s: s.with_df(s.df.withColumn("value", F.array_join(F.transform("value", lambda v: v.cast("string")), ",")))
    full = [r for r in batch(spark, folder, lambda s: listed(op.window(s, op.Chop(3)))) if r[3].count(",") == 2]
    assert run(spark, folder, tmp_path / "a", lambda s: listed(live_chop(s, 3))) == full
    full = [r for r in batch(spark, folder, lambda s: listed(op.window(s, op.Sliding(3)))) if r[3].count(",") == 2]
    assert run(spark, folder, tmp_path / "b", lambda s: listed(live_sliding(s, 3))) == full
    blocks = batch(spark, folder, lambda s: s.with_df(op.window(s, op.ChopTime(1000)).df.select("k", "seq", F.size("value").alias("n"))))
    last = {k: max(r[1] for r in blocks if r[0] == k) for k in "ab"}
    live = run(spark, folder, tmp_path / "c", lambda s: s.with_df(live_chop_time(s, 1000).df.select("k", "seq", F.size("value").alias("n"))))
    assert live == [r for r in blocks if r[1] < last[r[0]]]


def test_live_zip_and_expand(spark, folder, tmp_path):
    pairs = lambda s: s.with_df(s.df.select("k", "seq", "ts", F.col("value._1").alias("a"), F.col("value._2").alias("b")))
    odd = lambda s: s.with_df(s.df.where("value % 2 = 1"))
    assert run(spark, folder, tmp_path / "a", lambda x, y: pairs(live_zip(x, odd(y))), n=2) == batch(spark, folder, lambda x, y: pairs(op.join_zip(x, odd(y))), n=2)
    lists = lambda s: op.map_values(s.data(), lambda v: F.array(v, v + 1))
    got = run(spark, folder, tmp_path / "b", lambda s: live_expand(lists(s)))
    assert len(got) == 32 and {r[1] % (1 << 20) for r in got} == {0, 1}


def listed(s):
    return s.with_df(s.df.withColumn("value", F.array_join(F.transform("value", lambda v: v.cast("string")), ",")))


def test_live_sliding_time_and_aggregates(spark, folder, tmp_path):
    total = lambda s: op.map_values(s, lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x))
    full = batch(spark, folder, lambda s: total(op.window(s, op.SlidingTime(1700))))
    live = run(spark, folder, tmp_path, lambda s: total(live_sliding_time(s, 1700)), per_trigger=1)
    assert 10 < len(live) < len(full) and live == [r for r in full if (r[0], r[1]) in {(g[0], g[1]) for g in live}]


def test_live_sessions_equal_batch_sessions(spark, folder, tmp_path):
    odd = lambda s: s.with_df(s.df.where("seq % 6 < 3"))
    flat = lambda s: s.with_df(live_sessions(odd(s), 1000).df.select("k", "seq", "ts", F.col("value.value").alias("value"), F.col("value.session").alias("session"), F.col("value.start").alias("start")))
    live = run(spark, folder, tmp_path, flat, per_trigger=1)
    assert live == batch(spark, folder, lambda s: s.with_df(running_sessions(odd(s), 1000))) and max(r[4] for r in live) > 2


def test_live_merge_is_in_order(spark, folder, tmp_path):
    parts = lambda s: [s.with_df(s.df.where(f"seq % 3 = {k}")) for k in range(3)]
    live = run(spark, folder, tmp_path, lambda s: live_merge(parts(s)))
    full = batch(spark, folder, lambda s: op.merge(parts(s)))
    assert len(live) > 10 and live == [r for r in full if (r[0], r[1]) in {(g[0], g[1]) for g in live}]


def test_live_windowed_joins(spark, folder, tmp_path):
    three = lambda s: live_chop(s, 3)
    odd = lambda s: s.with_df(s.df.where("value % 2 = 1"))
    size = lambda a, b: F.array_max(a) * 100 + F.array_min(b)
    live = run(spark, folder, tmp_path / "a", lambda x, y: live_join_windows(x, odd(y), three, three, size), n=2)
    full = batch(spark, folder, lambda x, y: op.join_windows(x, odd(y), op.Chop(3), op.Chop(3), size), n=2)
    whole = {(r[0], r[1]) for r in live}
    assert live and live == [r for r in full if (r[0], r[1]) in whole]
    less, pair = lambda a, b: a < b, lambda a, b: a * 100 + b
    live = run(spark, folder, tmp_path / "b", lambda x, y: live_join_elements(x, odd(y), three, three, less, pair), n=2)
    full = batch(spark, folder, lambda x, y: op.join_elements(x, odd(y), op.Chop(3), op.Chop(3), less, pair), n=2)
    full = {k: [r[3] for r in full if r[0] == k] for k in "ab"}
    live = {k: [r[3] for r in live if r[0] == k] for k in "ab"}
    assert any(live.values()) and all(live[k] == full[k][: len(live[k])] for k in "ab")


def test_live_values_are_exact(spark, tmp_path):
    path = str(tmp_path / "in")
    big = (1 << 60) + 1
    spark.createDataFrame([(0, None, big, "a"), (1, None, None, "a"), (2, None, 1, "a")], SCHEMA).write.parquet(path)
    got = run(spark, path, tmp_path, lambda s: live_scan(s, lambda a, v: a + v, 0, T.LongType()))
    assert [r[1:] for r in got] == [(0, None, big), (1, None, None), (2, None, big + 1)]


def test_sink_function(spark, folder, tmp_path):
    seen = []
    q = node([EventStream(live_files(spark, folder, SCHEMA, per_trigger=1), ("k",))], lambda s: s, lambda df, n: seen.append(df.count()), checkpoint=str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert sum(seen) == 20


def test_connectors():
    env = to_environment("egress", "kafka", "broker", 9092, "t", 5)
    link = from_environment("egress", env)
    assert link.kind == "kafka" and link.options["subscribe"] == "t" and link.options["maxOffsetsPerTrigger"] == "5"
    assert from_environment("ingress", {}).options == {"host": "localhost", "port": "9001"}
    assert kafka("h").options["startingOffsets"] == "earliest" and mqtt("h").options["QoS"] == "0"
    with pytest.raises(ValueError):
        from_environment("ingress", {"RILLFLOW_INGRESS_TYPE": "pigeon"})


def test_a_tcp_link_joins_two_nodes(spark, folder, tmp_path):
    """One node doubles and sends, the other listens, counts and writes; the link carries whole events."""
    with socketlib.socket() as free:
        free.bind(("localhost", 0))
        port = free.getsockname()[1]
    link, out = tcp("localhost", port, 8), tmp_path / "out"
    received = decoded(link.read(spark), "k string, seq bigint, ts timestamp, value bigint", ("k",))
    listening = node([received], lambda s: s, "parquet", checkpoint=str(tmp_path / "cp"), path=str(out))
    try:
        sent = encoded(op.map_values(EventStream(live_files(spark, folder, SCHEMA), ("k",)), lambda v: v * 2))
        sending = link.write(sent).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        sending.awaitTermination(60)
        until = time.monotonic() + 40
        while time.monotonic() < until and (not list(out.glob("*.parquet")) or spark.read.schema(SCHEMA).parquet(str(out)).count() < 20):
            time.sleep(0.5)
    finally:
        listening.stop()
    double = lambda s: op.map_values(s, lambda v: v * 2)
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).select("k", "seq", "ts", "value").collect()) == batch(spark, folder, lambda s: s.with_df(double(s).df.select("k", "seq", "ts", "value")))


def test_file_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1529598787929,((-8,-16,-1000),0)\nbroken\n1529598787969,((1,2,3),1)\n")
    got = read_wearable_csv(spark, str(tmp_path / "w.csv")).df.orderBy("seq").collect()
    assert [tuple(r.value) for r in got] == [(-8, -16, -1000, 0), (1, 2, 3, 1)] and got[0].ts.microsecond == 929000
    (tmp_path / "r.csv").write_text("1000," + ",".join(f"{k},{k + 1},{k + 2},0" for k in range(10)) + ",0\n")
    raw = read_wearable_raw(spark, str(tmp_path / "r.csv")).df.orderBy("seq").collect()
    assert len(raw) == 10 and tuple(raw[3].value) == (3, 4, 5, 0)
    (tmp_path / "t.csv").write_text("m1,h1,2013-01-01 00:00:00,2013-01-01 00:02:00,120,0.44,-73.95,40.71,-73.95,40.71,CSH,3.5,0.5,0.5,0,0,4.5\n")
    trip = read_taxi_csv(spark, str(tmp_path / "t.csv")).df.first()
    assert trip.value.payment_type == "cash" and trip.ts.minute == 2


def test_csv_rows_have_numbers_of_their_own(spark, tmp_path):
    line = "m{},h1,2013-01-01 00:00:00,2013-01-0{} 00:0{}:00,120,0.44,-73.95,40.71,-73.95,40.71,CSH,3.5,0.5,0.5,0,0,4.5\n"
    (tmp_path / "t.csv").write_text("".join(line.format(k % 3, 1 + k % 5, k % 7) for k in range(100)) + "m9,h1,,,1,,,,,,,,,,,,\n")
    trips = read_taxi_csv(spark, str(tmp_path / "t.csv"))
    got = trips.df.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(101)) and got[-1].value.medallion == "m9"
    assert [r.ts for r in got[:-1]] == sorted(r.ts for r in got[:-1])
    (tmp_path / "w.csv").write_text("1000,((1,2,3),0)\n1000,((1,2,4),0)\n1000,((1,2,3),0)\n999,((9,9,9),1)\n")
    read = read_wearable_csv(spark, str(tmp_path / "w.csv")).df.orderBy("seq").collect()
    assert [(r.seq, r.value.z) for r in read] == [(0, 9), (1, 3), (2, 3), (3, 4)]


def test_live_expand_refuses_lists_that_are_too_long(spark):
    from rillflow import EventStream

    df = spark.createDataFrame([(0, [1, 2, 3])], "seq bigint, value array<int>")
    stream = EventStream.of(df, "seq", "value")
    assert live_expand(stream, 3).df.count() == 3
    with pytest.raises(Exception, match="more than 2 elements"):
        live_expand(stream, 2).df.collect()
