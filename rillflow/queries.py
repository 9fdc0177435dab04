"""The query catalogue over the ``events`` table (and ``part``, ``documents``), each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apps import taxi, wearable
from .events import EventStream, micros
from .functions import hashtags, upper_median
from .operators import (
    Chop,
    ChopTime,
    Complete,
    Custom,
    Sliding,
    SlidingTime,
    changes,
    expand,
    filter_acc,
    filter_events,
    join_elements,
    join_windows,
    join_zip,
    map_cache,
    map_values,
    merge,
    record_highs,
    reduce_stream,
    sample,
    scan,
    scan_fold,
    sessions,
    steps,
    stream_graph,
    window,
    window_aggregate,
)
from .operators.ranked import top_counts
from .operators.windows import WINDOW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Half an hour and five minutes, in milliseconds.
HALF_HOUR, FIVE_MINUTES = 1_800_000, 300_000
#: Spans of ``event_id`` that one task numbers or scans.
BUCKET = 1 << 20

#: Rows of events as the queries see them: every seventh has no value; amounts are whole cents.
E = """WITH e AS (SELECT event_id AS seq, epoch_us(ts) AS us, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS v,
 user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS c FROM events)"""


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def links_dir(spark: SparkSession) -> str:
    """A new folder for the links between stages: in ``spark.checkpoint.dir``, or on a local master a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(top or tempfile.mkdtemp(prefix='rillflow-')).rstrip('/')}/links-{uuid.uuid4().hex}"


def cents() -> Column:
    return F.floor(F.col("value") * 100).cast("long")


def events(spark: SparkSession, sf_dir: str, value: Column | None = None, where: str | None = None, gaps: bool = True, key: tuple[str, ...] = ()) -> EventStream:
    """The events table as a stream; ``gaps``: every seventh event has no value."""
    rows = table(spark, sf_dir, "events")
    rows = rows.where(where) if where else rows
    v = cents() if value is None else value
    return EventStream.of(rows, "event_id", F.when(F.col("event_id") % 7 != 0, v) if gaps else v, "ts", key, BUCKET)


def timed(stream: EventStream | DataFrame, *extra: str) -> DataFrame:
    """seq, us and value of a stream."""
    df = stream.df if isinstance(stream, EventStream) else stream
    return df.select("seq", micros().alias("us"), "value", *extra)


@query("stream_filter", E + " SELECT seq, us, v AS value FROM e WHERE v > 10000 OR v IS NULL")
def stream_filter(spark, sf_dir):
    return timed(filter_events(events(spark, sf_dir), lambda v: v > 10000))


@query("stream_map", E + " SELECT seq, us, v * 2 AS value FROM e")
def stream_map(spark, sf_dir):
    return timed(map_values(events(spark, sf_dir), lambda v: v * 2))


@query("simplest_pipeline", E + " SELECT seq, us, (v % 10 + 1) * 2 + 1 AS value FROM e WHERE (v % 10 + 1) * 2 + 1 < 15 OR v IS NULL")
def simplest_pipeline(spark, sf_dir):
    s = map_values(map_values(events(spark, sf_dir, cents() % 10 + 1), lambda v: v * 2), lambda v: v + 1)
    return timed(filter_events(s, lambda v: v < 15))


@query("stream_scan_count", E + " SELECT seq, us, CASE WHEN v IS NOT NULL THEN count(v) OVER (ORDER BY seq) END AS value FROM e")
def stream_scan_count(spark, sf_dir):
    return timed(scan(events(spark, sf_dir), "count"))


@query("stream_scan_sum", E + " SELECT seq, us, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER (ORDER BY seq) AS BIGINT) END AS value FROM e")
def stream_scan_sum(spark, sf_dir):
    return timed(scan(events(spark, sf_dir), "sum"))


@query("stream_scan_by_user", E + " SELECT user_id, seq, us, CASE WHEN v IS NOT NULL THEN max(v) OVER (PARTITION BY user_id ORDER BY seq) END AS value FROM e")
def stream_scan_by_user(spark, sf_dir):
    return timed(scan(events(spark, sf_dir, key=("user_id",)), "max"), "user_id")


@query(
    "stream_scan_fold",
    E + ", p AS (SELECT user_id, seq, us, v, CAST(sum(CASE WHEN v IS NULL THEN 0 ELSE v % 97 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS s FROM e) SELECT user_id, seq, us, CASE WHEN v IS NOT NULL THEN (s + 5) % 1000 END AS value FROM p",
)
def stream_scan_fold(spark, sf_dir):
    """A fold of arbitrary code, streamed through Python key by key."""
    return timed(scan_fold(events(spark, sf_dir, key=("user_id",)), lambda acc, v: (acc + v % 97) % 1000, 5, T.LongType()), "user_id")


@query(
    "filter_acc_fold",
    E + ", p AS (SELECT user_id, seq, us, v, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS n FROM e) SELECT user_id, seq, us, v AS value FROM p WHERE v IS NULL OR (n - 1) % 3 = 0",
)
def filter_acc_fold(spark, sf_dir):
    return timed(filter_acc(events(spark, sf_dir, key=("user_id",)), lambda acc, v: (acc + 1) % 3, 0, lambda v, acc: acc == 0), "user_id")


_BLOCKS = """, b AS (SELECT (us - (SELECT min(us) FROM e)) // 300000000 AS k, us FROM e),
 n AS (SELECT g.k AS seq, min(b.us) AS us, count(b.k) AS n FROM (SELECT unnest(range((SELECT max(k) + 1 FROM b))) AS k) g LEFT JOIN b USING (k) GROUP BY g.k)"""


@query("running_rate", E + _BLOCKS + " SELECT seq, us, n, sum(n) OVER (ORDER BY seq) / CAST(count(*) OVER (ORDER BY seq) AS DOUBLE) AS mean FROM n")
def running_rate(spark, sf_dir):
    rates = wearable.rates(events(spark, sf_dir), FIVE_MINUTES)
    return rates.select("seq", micros().alias("us"), "n", "mean")


@query("running_rate_busy", E + _BLOCKS + " SELECT seq, us, n, sum(n) OVER (ORDER BY seq) / CAST(count(*) OVER (ORDER BY seq) AS DOUBLE) AS mean FROM n WHERE n > 0")
def running_rate_busy(spark, sf_dir):
    """Blocks without events do not count."""
    rates = wearable.rates(events(spark, sf_dir), FIVE_MINUTES, with_empty=False)
    return rates.select("seq", micros().alias("us"), "n", "mean")


@query("window_custom", E + " SELECT seq // 250 AS seq, arg_min(us, seq) AS us, CAST(sum(v) AS BIGINT) AS value FROM e WHERE v IS NOT NULL GROUP BY 1")
def window_custom(spark, sf_dir):
    """Windows by a rule of one's own: spans of the sequence number."""
    spans = Custom(lambda s: s.data().df.withColumn(WINDOW, F.floor(F.col("seq") / 250).cast("long")))
    return timed(window_aggregate(events(spark, sf_dir), spans, "sum"))


@query(
    "journey_changes",
    E + ", p AS (SELECT seq, us, v // 3000 AS a, lag(v // 3000) OVER (ORDER BY seq) AS b FROM e WHERE v IS NOT NULL) SELECT seq, us, a AS value FROM p WHERE b IS NULL OR a <> b UNION ALL SELECT seq, us, NULL FROM e WHERE v IS NULL",
)
def journey_changes(spark, sf_dir):
    """Changes by a component of the value, whatever the rest of it."""
    pair = F.struct(F.floor(cents() / 3000).cast("long").alias("a"), F.col("event_id").alias("b"))
    rows = changes(events(spark, sf_dir, pair), lambda v: v["a"]).df
    return rows.select("seq", micros().alias("us"), F.col("value.a").alias("value"))


@query("rate_histogram", E + _BLOCKS + " SELECT n AS rate, count(*) AS blocks FROM n GROUP BY n")
def rate_histogram(spark, sf_dir):
    return wearable.rate_histogram(events(spark, sf_dir), FIVE_MINUTES)


@query("movement_histogram", E + " SELECT event_type AS class, seq, count(*) OVER (PARTITION BY event_type ORDER BY seq) AS n FROM e")
def movement_histogram(spark, sf_dir):
    return wearable.histogram(events(spark, sf_dir, F.col("event_type"), gaps=False), F.col("value")).select("class", "seq", "n")


@query("filter_acc_changes", E + ", p AS (SELECT *, lag(event_type) OVER (ORDER BY seq) AS b FROM e) SELECT seq, us, event_type AS value FROM p WHERE event_type IS DISTINCT FROM b")
def filter_acc_changes(spark, sf_dir):
    return timed(changes(events(spark, sf_dir, F.col("event_type"), gaps=False)))


@query("filter_acc_sample", E + ", p AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM e WHERE v IS NOT NULL) SELECT seq, us, v AS value FROM p WHERE r % 4 = 0 UNION ALL SELECT seq, us, v FROM e WHERE v IS NULL")
def filter_acc_sample(spark, sf_dir):
    return timed(sample(events(spark, sf_dir), 3))


@query("filter_acc_step", E + ", p AS (SELECT *, lag(v, 1, 0) OVER (ORDER BY seq) AS b FROM e WHERE v IS NOT NULL) SELECT seq, us, v AS value FROM p WHERE b > 15000 AND v <= 15000 UNION ALL SELECT seq, us, v FROM e WHERE v IS NULL")
def filter_acc_step(spark, sf_dir):
    return timed(steps(events(spark, sf_dir), 15000))


@query(
    "filter_acc_recordhigh",
    E + ", p AS (SELECT *, max(v) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WHERE v IS NOT NULL) SELECT seq, us, v AS value FROM p WHERE b IS NULL OR v > b UNION ALL SELECT seq, us, v FROM e WHERE v IS NULL",
)
def filter_acc_recordhigh(spark, sf_dir):
    return timed(record_highs(events(spark, sf_dir)))


_DATA = ", d AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r FROM e WHERE v IS NOT NULL)"


def _listed(column: str = "value") -> Column:
    return F.array_join(F.transform(F.col(column), lambda v: v.cast("string")), ",")


@query("window_sliding", E + _DATA + " SELECT r AS seq, us, array_to_string(list(v) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ',') AS value FROM d")
def window_sliding(spark, sf_dir):
    s = window(events(spark, sf_dir), Sliding(5))
    return timed(s.with_df(s.df.withColumn("value", _listed())))


@query("window_sliding_sum", E + _DATA + " SELECT r AS seq, us, CAST(sum(v) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS value FROM d")
def window_sliding_sum(spark, sf_dir):
    return timed(window_aggregate(events(spark, sf_dir), Sliding(5), "sum"))


_ALL = ", d AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r FROM e)"


@query("window_sliding_time", E + _ALL + " SELECT r AS seq, us, count(v) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) AS value FROM d")
def window_sliding_time(spark, sf_dir):
    return timed(window_aggregate(events(spark, sf_dir), SlidingTime(HALF_HOUR, peers=True), "count"))


@query("window_sliding_time_max", E + _ALL + " SELECT r AS seq, us, max(v) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) AS value FROM d")
def window_sliding_time_max(spark, sf_dir):
    return timed(window_aggregate(events(spark, sf_dir), SlidingTime(HALF_HOUR, peers=True), "max"))


@query("window_chop", E + _DATA + " SELECT r // 10 AS seq, min(us) AS us, string_agg(v, ',' ORDER BY r) AS value FROM d GROUP BY r // 10")
def window_chop(spark, sf_dir):
    s = window(events(spark, sf_dir), Chop(10))
    return timed(s.with_df(s.df.withColumn("value", _listed())))


_CHOPPED = """, b AS (SELECT (us - (SELECT min(us) FROM e)) // 300000000 AS k, us, v FROM e)"""
_GRID = " FROM (SELECT unnest(range((SELECT max(k) + 1 FROM b))) AS k) g LEFT JOIN b USING (k) GROUP BY g.k"


@query("window_chop_time", E + _CHOPPED + " SELECT g.k AS seq, min(b.us) AS us, CAST(count(b.v) AS BIGINT) AS value" + _GRID)
def window_chop_time(spark, sf_dir):
    s = window(events(spark, sf_dir), ChopTime(FIVE_MINUTES))
    return timed(s.with_df(s.df.withColumn("value", F.size("value").cast("long"))))


@query("window_complete", E + " SELECT CAST(0 AS BIGINT) AS seq, min(us) AS us, count(v) AS value FROM e")
def window_complete(spark, sf_dir):
    return timed(window_aggregate(events(spark, sf_dir), Complete(), "count"))


@query("stream_reduce", E + " SELECT CAST(sum(v) AS BIGINT) AS value FROM e")
def stream_reduce(spark, sf_dir):
    return reduce_stream(events(spark, sf_dir), F.sum)


@query("window_aggregate_sum", E + _CHOPPED + " SELECT g.k AS seq, min(b.us) AS us, CAST(sum(b.v) AS BIGINT) AS value" + _GRID)
def window_aggregate_sum(spark, sf_dir):
    return timed(window_aggregate(events(spark, sf_dir), ChopTime(FIVE_MINUTES, ordered=True), "sum"))


@query("stream_expand", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey, i) - 1 AS BIGINT) AS seq, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def stream_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    lists = F.transform(F.split("p_name", " "), lambda w: F.struct(F.col("p_partkey").alias("k"), w.alias("w")))
    return expand(EventStream.of(rows, "p_partkey", lists, bucket=BUCKET)).df.select(F.col("value.k").alias("p_partkey"), "seq", F.col("value.w").alias("value"))


@query("expand_hashtag", r"SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(text), '\s+')) AS w FROM documents) WHERE starts_with(w, 'th') GROUP BY w")
def expand_hashtag(spark, sf_dir):
    docs = EventStream.of(table(spark, sf_dir, "documents"), "doc_id", "text", bucket=BUCKET)
    tags = expand(map_values(docs, lambda text: hashtags(text, "th")))
    return tags.df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("stream_graph", E + " SELECT seq, us, v * m AS value FROM e, (VALUES (1), (2)) t(m) WHERE v IS NOT NULL")
def stream_graph_query(spark, sf_dir):
    s = stream_graph(events(spark, sf_dir, F.struct(F.col("event_id").alias("id"), cents().alias("c"))).data(), lambda v: F.transform(F.array(F.lit(1), F.lit(2)), lambda m: F.struct(v["id"].alias("id"), (v["c"] * m).alias("c"))))
    return s.df.select(F.col("value.id").alias("seq"), micros().alias("us"), F.col("value.c").alias("value"))


@query("stream_merge", E + " SELECT row_number() OVER (ORDER BY us, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, seq) - 1 AS seq, us, c AS value FROM e WHERE event_type IN ('click', 'view', 'purchase')")
def stream_merge(spark, sf_dir):
    return timed(merge([events(spark, sf_dir, where=f"event_type = '{kind}'", gaps=False) for kind in ("click", "view", "purchase")]))


_SIDES = """, l AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS r, us, v FROM e WHERE event_type = 'click' AND v IS NOT NULL),
 m AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS r, us, v FROM e WHERE event_type = 'view' AND v IS NOT NULL)"""


def _sides(spark, sf_dir) -> tuple[EventStream, EventStream]:
    return events(spark, sf_dir, where="event_type = 'click'"), events(spark, sf_dir, where="event_type = 'view'")


@query("stream_join_zip", E + _SIDES + " SELECT l.r AS seq, l.us AS us, l.v AS a, m.v AS b FROM l JOIN m ON l.r = m.r")
def stream_join_zip(spark, sf_dir):
    return join_zip(*_sides(spark, sf_dir)).df.select("seq", micros().alias("us"), F.col("value._1").alias("a"), F.col("value._2").alias("b"))


@query(
    "stream_join_e",
    E + _SIDES + ", w AS (SELECT r // 10 AS w, min(us) AS us FROM l GROUP BY 1) SELECT row_number() OVER (ORDER BY w.w, l.r, m.r) - 1 AS seq, w.us AS us, l.v + m.v AS value FROM l JOIN m ON l.r // 10 = m.r // 10 AND l.v < m.v JOIN w ON w.w = l.r // 10",
)
def stream_join_e(spark, sf_dir):
    return timed(join_elements(*_sides(spark, sf_dir), Chop(10), Chop(10), lambda a, b: a < b, lambda a, b: a + b))


@query("stream_join_w", E + _SIDES + ", a AS (SELECT r // 10 AS w, min(us) AS us, sum(v) AS s FROM l GROUP BY 1), b AS (SELECT r // 10 AS w, max(v) AS t FROM m GROUP BY 1) SELECT w AS seq, us, CAST(s + t AS BIGINT) AS value FROM a JOIN b USING (w)")
def stream_join_w(spark, sf_dir):
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    return timed(join_windows(*_sides(spark, sf_dir), Chop(10), Chop(10), lambda a, b: total(a) + F.array_max(b)))


_SESSIONS = """, g AS (SELECT *, CASE WHEN lag(us) OVER (ORDER BY seq) IS NULL OR us - lag(us) OVER (ORDER BY seq) > 900000000 THEN 1 ELSE 0 END AS n FROM e),
 s AS (SELECT seq, us, CAST(sum(n) OVER (ORDER BY seq) AS BIGINT) AS session FROM g)"""


@query("session_label", E + _SESSIONS + " SELECT seq, us, session FROM s")
def session_label(spark, sf_dir):
    return sessions(events(spark, sf_dir), 900_000).select("seq", micros().alias("us"), "session")


@query("select_session", E + _SESSIONS + " SELECT seq, us FROM s WHERE session = 2")
def select_session(spark, sf_dir):
    return wearable.select_session(events(spark, sf_dir), 2).df.select("seq", micros().alias("us"))


@query("session_running", E + _SESSIONS + " SELECT seq, us, session, min(us) OVER (PARTITION BY session) AS start_us FROM s")
def session_running(spark, sf_dir):
    """At each event, the session it is in and when that began: its length so far."""
    return wearable.running_sessions(events(spark, sf_dir)).select("seq", micros().alias("us"), "session", micros("start").alias("start_us"))


@query("session_length", E + _SESSIONS + " SELECT session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY session")
def session_length(spark, sf_dir):
    return wearable.session_lengths(events(spark, sf_dir)).select("session", micros("start").alias("first_us"), micros("end").alias("last_us"), "n")


@query("upper_median", E + " SELECT event_type, list_sort(list(c))[len(list(c)) // 2 + 1] AS value FROM e GROUP BY event_type")
def upper_median_query(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(upper_median(F.collect_list(cents())).alias("value"))


_HALF_HOURS = ", j AS (SELECT a.r AS w, b.event_type AS t FROM d a JOIN d b ON b.us >= a.us AND b.us < a.us + 1800000000 AND b.us // 1800000000 IN (a.us // 1800000000, a.us // 1800000000 + 1))"


@query(
    "topk_window",
    E + _ALL + _HALF_HOURS + ", c AS (SELECT w, t, count(*) AS n FROM j GROUP BY w, t) SELECT w AS window_id, t AS value, n, row_number() OVER (PARTITION BY w ORDER BY n DESC, t) AS rank FROM c QUALIFY rank <= 2",
)
def topk_window(spark, sf_dir):
    return top_counts(events(spark, sf_dir, F.col("event_type"), gaps=False), SlidingTime(HALF_HOUR, peers=True), 2)


@query("map_cache", "SELECT event_id AS seq, epoch_us(ts) AS us, (user_id * 7919) % 1000003 AS value FROM events")
def map_cache_query(spark, sf_dir):
    return timed(map_cache(events(spark, sf_dir, F.col("user_id"), gaps=False), lambda v: (v * 7919) % 1000003))


_STEPS = """, m AS (SELECT seq, us, CAST(round(sqrt((c % 100) * (c % 100) + (user_id % 50) * (user_id % 50) + (seq % 30) * (seq % 30))) AS BIGINT) AS v FROM e WHERE event_type <> 'error'),
 p AS (SELECT *, lag(v, 1, 0) OVER (ORDER BY seq) AS before FROM m), s AS (SELECT us FROM p WHERE before > 60 AND v <= 60),
 b AS (SELECT (us - (SELECT min(us) FROM s)) // 120000000 AS k, us FROM s)"""


@query("wearable_steps", E + _STEPS + " SELECT g.k AS seq, min(b.us) AS us, count(b.us) AS value" + _GRID)
def wearable_steps(spark, sf_dir):
    vibe = F.when(F.col("event_type") == "error", 1).otherwise(0)
    reading = F.struct((cents() % 100).alias("x"), (F.col("user_id") % 50).alias("y"), (F.col("event_id") % 30).alias("z"), vibe.alias("vibe"))
    return timed(wearable.step_counts(events(spark, sf_dir, reading, gaps=False), 60, 120_000))


def _trips(spark: SparkSession, sf_dir: str) -> EventStream:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fields = {"start": F.col("user_id") % 10, "end": F.col("event_id") % 7, "pickup": us - (F.col("event_id") % 20) * 60_000_000, "dropoff": us, "medallion": F.col("user_id"), "fare": cents(), "tip": F.col("event_id") % 100}
    return events(spark, sf_dir, F.struct(*[c.alias(n) for n, c in fields.items()]), gaps=False)


_TRIPS = """, t AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS w FROM (SELECT seq, us, user_id % 10 AS s, seq % 7 AS f, user_id AS m, us - (seq % 20) * 60000000 AS pick, c + seq % 100 AS earn FROM e) WHERE s BETWEEN 1 AND 9 AND f BETWEEN 1 AND 6)"""


def _pairs(name: str, span: int) -> str:
    return f", {name} AS (SELECT a.w AS w, a.us AS us0, b.* EXCLUDE (w) FROM t a JOIN t b ON b.w >= a.w AND b.us < a.us + {span} AND b.us // {span} IN (a.us // {span}, a.us // {span} + 1))"


_CHANGED = ", z AS (SELECT *, lag(value) OVER (ORDER BY w) AS before, row_number() OVER (ORDER BY w) AS i FROM o) SELECT w AS seq, us, value FROM z WHERE i = 1 OR value IS DISTINCT FROM before"


@query(
    "taxi_q1",
    E + _TRIPS + _pairs("j", 1_800_000_000) + """, c AS (SELECT w, us0, s, f, count(*) AS n FROM j GROUP BY w, us0, s, f),
 k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, s, f) AS rank FROM c QUALIFY rank <= 10),
 o AS (SELECT w, us0 AS us, string_agg(s || ':' || f || ':' || n, ',' ORDER BY rank) AS value FROM k GROUP BY w, us0)""" + _CHANGED,
)
def taxi_q1(spark, sf_dir):
    return timed(taxi.frequent_routes(_trips(spark, sf_dir), 9, 6))


@query(
    "taxi_q2",
    E + _TRIPS + _pairs("q", 900_000_000) + _pairs("h", 1_800_000_000) + """, p AS (SELECT w, s, list_sort(list(earn))[len(list(earn)) // 2 + 1] AS profit FROM q GROUP BY w, s),
 x AS (SELECT w, s, us, max(pick) OVER (PARTITION BY w, s, m) AS newest FROM h), n AS (SELECT w, s, count(*) AS n FROM x WHERE newest < us GROUP BY w, s),
 r AS (SELECT n.w, n.s, CAST(floor(coalesce(p.profit, 0) * 1000.0::DOUBLE / n.n) AS BIGINT) AS rate FROM n LEFT JOIN p ON n.w = p.w AND n.s = p.s),
 k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rate DESC, s) AS rank FROM r QUALIFY rank <= 10),
 y AS (SELECT w, string_agg(s || ':' || rate, ',' ORDER BY rank) AS value FROM k GROUP BY w),
 o AS (SELECT t.w, t.us, coalesce(y.value, '') AS value FROM t LEFT JOIN y ON t.w = y.w)""" + _CHANGED,
)
def taxi_q2(spark, sf_dir):
    return timed(taxi.profitable_cells(_trips(spark, sf_dir), 9, 6))


# Rewrite rules: the rewritten program, lowered, against SQL of the program as written.

from .plans import rewriting as rw  # noqa: E402
from .plans.graph import Fold, Graph, Kind, Node, chain, joined  # noqa: E402
from .plans.lowering import lower  # noqa: E402


def _source(stream: EventStream) -> Node:
    return Node(0, Kind.SOURCE, stream=stream)


def _rewritten(rule: rw.Rule, graph: Graph) -> EventStream:
    out = rw.apply(rule, graph)
    if out is None:
        raise ValueError(f"{rule.__name__} does not match")
    return lower(out)


LONGS = T.ArrayType(T.LongType())
_sum = Fold(lambda acc, v: acc + v, 0)
_last = Fold(lambda acc, v: v, 0)


def _is_rise(v, acc):
    return v > acc


def _over(v):
    return v > 5000


def _odd(v):
    return v % 2 == 1


def _double(v):
    return v * 2


def _n(kind: Kind, fn=None, **more) -> Node:
    return Node(0, kind, fn=fn, **more)


#: Rewritten programs over one keyed stream: rule, operators after the source, and SQL over d (data events by user, numbered).
_BY_USER = E + ", d AS (SELECT user_id, seq, us, v FROM e WHERE v IS NOT NULL)"
_LAG = "lag({0}, 1, 0) OVER (PARTITION BY user_id ORDER BY seq)"
_VALUES: dict[str, tuple[rw.Rule, list[Node], str]] = {
    "filter_fuse": (rw.filter_fuse, [_n(Kind.FILTER, _over), _n(Kind.FILTER, _odd)], "SELECT user_id, seq, v AS value FROM d WHERE v > 5000 AND v % 2 = 1"),
    "map_filter": (rw.map_filter, [_n(Kind.MAP, _double), _n(Kind.FILTER, _over)], "SELECT user_id, seq, v * 2 AS value FROM d WHERE v * 2 > 5000"),
    "filter_filter_acc": (rw.filter_filter_acc, [_n(Kind.FILTER, _over), _n(Kind.FILTER_ACC, _is_rise, fold=_last)], f"SELECT user_id, seq, v AS value FROM (SELECT *, {_LAG.format('v')} AS b FROM d WHERE v > 5000) WHERE v > b"),
    "filter_acc_filter": (rw.filter_acc_filter, [_n(Kind.FILTER_ACC, _is_rise, fold=_last), _n(Kind.FILTER, _odd)], f"SELECT user_id, seq, v AS value FROM (SELECT *, {_LAG.format('v')} AS b FROM d) WHERE v > b AND v % 2 = 1"),
    "filter_acc_filter_acc": (
        rw.filter_acc_filter_acc,
        [_n(Kind.FILTER_ACC, _is_rise, fold=_last), _n(Kind.FILTER_ACC, _is_rise, fold=_last)],
        f"SELECT user_id, seq, v AS value FROM (SELECT *, {_LAG.format('v')} AS b2 FROM (SELECT *, {_LAG.format('v')} AS b FROM d) WHERE v > b) WHERE v > b2",
    ),
    "map_fuse": (rw.map_fuse, [_n(Kind.MAP, _double), _n(Kind.MAP, _double)], "SELECT user_id, seq, v * 4 AS value FROM d"),
    "map_scan": (rw.map_scan, [_n(Kind.MAP, _double), _n(Kind.SCAN, fold=_sum)], "SELECT user_id, seq, CAST(sum(v * 2) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS value FROM d"),
    "map_filter_acc": (rw.map_filter_acc, [_n(Kind.MAP, _double), _n(Kind.FILTER_ACC, _is_rise, fold=_last)], f"SELECT user_id, seq, v AS value FROM (SELECT user_id, seq, v * 2 AS v, {_LAG.format('v * 2')} AS b FROM d) WHERE v > b"),
    "map_window": (
        rw.map_window,
        [_n(Kind.MAP, _double), _n(Kind.WINDOW, maker=Chop(3))],
        "SELECT user_id, r // 3 AS seq, string_agg(v * 2, ',' ORDER BY r) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS r FROM d) GROUP BY 1, 2",
    ),
}


def _values_query(rule: rw.Rule, nodes: list[Node]) -> Query:
    def run(spark, sf_dir):
        out = _rewritten(rule, chain(_source(events(spark, sf_dir, key=("user_id",)).data()), *nodes)).df
        return out.select("user_id", "seq", _listed().alias("value") if isinstance(out.schema["value"].dataType, T.ArrayType) else F.col("value"))

    return run


for _name, (_r, _nodes, _sql) in _VALUES.items():
    query(f"rw_{_name}", f"{_BY_USER} {_sql}")(_values_query(_r, _nodes))

#: Programs that expand lists: each event holds its amount and the two after it in whole thousands (l), expanded in order.
_LISTS = _BY_USER + ", x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq, i) - 1 AS seq, CAST(CASE i WHEN 0 THEN v ELSE v // (10 * i) END AS BIGINT) AS v FROM d, (VALUES (0), (1), (2)) t(i))"
#: Places of the rows that are left: the rewritten program drops values before it numbers them.
_PLACE = "row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1"
_EXPANDS: dict[str, tuple[rw.Rule, list[Node], str]] = {
    "expand_filter": (rw.expand_filter, [_n(Kind.EXPAND), _n(Kind.FILTER, _over)], f"SELECT user_id, {_PLACE} AS seq, v AS value FROM x WHERE v > 5000"),
    "expand_map": (rw.expand_map, [_n(Kind.EXPAND), _n(Kind.MAP, _double)], "SELECT user_id, seq, v * 2 AS value FROM x"),
    "expand_scan": (rw.expand_scan, [_n(Kind.EXPAND), _n(Kind.SCAN, fold=_sum, out=T.LongType())], "SELECT user_id, seq, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS value FROM x"),
    "expand_filter_acc": (rw.expand_filter_acc, [_n(Kind.EXPAND), _n(Kind.FILTER_ACC, _is_rise, fold=_last)], f"SELECT user_id, {_PLACE} AS seq, v AS value FROM (SELECT *, {_LAG.format('v')} AS b FROM x) WHERE v > b"),
    "expand_expand": (rw.expand_expand, [_n(Kind.MAP, lambda v: F.array(v, v)), _n(Kind.EXPAND), _n(Kind.EXPAND)], "SELECT user_id, 6 * (seq // 3) + 3 * m + seq % 3 AS seq, v AS value FROM x, (VALUES (0), (1)) t(m)"),
}


def _expands_query(rule: rw.Rule, nodes: list[Node]) -> Query:
    def run(spark, sf_dir):
        c = cents()
        lists = F.array(c, F.floor(c / 10).cast("long"), F.floor(c / 20).cast("long"))
        out = _rewritten(rule, chain(_source(events(spark, sf_dir, lists, key=("user_id",)).data()), *nodes)).df
        return out.select("user_id", "seq", "value")

    return run


for _name, (_r, _nodes, _sql) in _EXPANDS.items():
    query(f"rw_{_name}", f"{_LISTS} {_sql}")(_expands_query(_r, _nodes))

_TYPES = ("click", "view", "purchase")
#: d: the events of the three streams at their places in the merge; those of a rewritten program are of what it merges.
_MERGED = E + ", d AS (SELECT row_number() OVER (ORDER BY us, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, seq) - 1 AS seq, us, c AS v FROM e WHERE event_type IN ('click', 'view', 'purchase'))"
_TWICE = "SELECT 2 * seq + m AS seq, us, v AS value FROM d, (VALUES (0), (1)) t(m)"


def _merges(spark, sf_dir, value: Column, *before: Node) -> list[Graph]:
    return [chain(_source(events(spark, sf_dir, value, f"event_type = '{t}'", gaps=False)), *before) for t in _TYPES]


def _merge_query(rule: rw.Rule, before: list[Node], after: list[Node], lists: bool = False, nested: bool = False) -> Query:
    def run(spark, sf_dir):
        c = cents()
        parts = _merges(spark, sf_dir, F.array(c, c) if lists else c, *before)
        merge_ = _n(Kind.MERGE)
        graph = joined([joined(parts[:2], merge_), parts[2]], merge_, *after) if nested else joined(parts, merge_, *after)
        return timed(_rewritten(rule, graph))

    return run


for _name, (_query, _sql) in {
    "merge_filter": (_merge_query(rw.merge_filter, [], [_n(Kind.FILTER, _over)]), "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, us, v AS value FROM d WHERE v > 5000"),
    "merge_map": (_merge_query(rw.merge_map, [], [_n(Kind.MAP, _double)]), "SELECT seq, us, v * 2 AS value FROM d"),
    "merge_expand": (_merge_query(rw.merge_expand, [], [_n(Kind.EXPAND)], True), _TWICE),
    "map_merge": (_merge_query(rw.map_merge, [_n(Kind.MAP, _double)], [_n(Kind.SINK)]), "SELECT seq, us, v * 2 AS value FROM d"),
    "filter_merge": (_merge_query(rw.filter_merge, [_n(Kind.FILTER, _over)], [_n(Kind.SINK)]), "SELECT seq, us, v AS value FROM d WHERE v > 5000"),
    "expand_merge": (_merge_query(rw.expand_merge, [_n(Kind.EXPAND)], [_n(Kind.SINK)], True), _TWICE),
    "merge_fuse": (_merge_query(rw.merge_fuse, [], [_n(Kind.SINK)], nested=True), "SELECT seq, us, v AS value FROM d"),
}.items():
    query(f"rw_{_name}", f"{_MERGED} {_sql}")(_query)

#: Reshaping rules change what windows hold: SQL of what the rewritten program means.
_CHOPS = _BY_USER + ", w AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 3 AS k FROM d)"


@query("rw_filter_window", _CHOPS + " SELECT user_id, k AS seq, count(*) FILTER (v > 5000) AS value FROM w GROUP BY 1, 2")
def rw_filter_window(spark, sf_dir):
    out = _rewritten(rw.filter_window, chain(_source(events(spark, sf_dir, key=("user_id",)).data()), _n(Kind.FILTER, _over), _n(Kind.WINDOW, maker=Chop(3)))).df
    return out.select("user_id", "seq", F.size("value").cast("long").alias("value"))


@query("rw_filter_acc_window", _CHOPS + f", p AS (SELECT *, {_LAG.format('v')} AS b FROM w) SELECT user_id, k AS seq, count(*) FILTER (v > b) AS value FROM p GROUP BY 1, 2")
def rw_filter_acc_window(spark, sf_dir):
    out = _rewritten(rw.filter_acc_window, chain(_source(events(spark, sf_dir, key=("user_id",)).data()), _n(Kind.FILTER_ACC, _is_rise, fold=_last), _n(Kind.WINDOW, maker=Chop(3)))).df
    return out.select("user_id", "seq", F.size("value").cast("long").alias("value"))


# The planner, on programs whose figures are known.

from .plans import fixtures  # noqa: E402
from .plans.costs import depart_rate, loads  # noqa: E402
from .plans.lowering import run_staged  # noqa: E402
from .plans.partitions import all_partitions  # noqa: E402
from .plans.planner import Options, plan_cost, plans_of, viable_plans  # noqa: E402


@query("plan_jackson", "SELECT * FROM (VALUES (1, 1200), (2, 1200), (3, 1200), (4, 1140), (5, 1140), (6, 1140), (7, 114)) t(id, per_1000_s)")
def plan_jackson(spark, sf_dir):
    return spark.createDataFrame([(x.id, round(x.arrival * 1000)) for x in loads(fixtures.taxi())], "id int, per_1000_s int")


@query("plan_partitions", "SELECT * FROM (VALUES ('path', 3), ('merge', 2), ('two_maps', 8), ('wearable', 127)) t(program, splits)")
def plan_partitions(spark, sf_dir):
    programs = {"path": fixtures.path(), "merge": fixtures.merged(), "two_maps": fixtures.two_maps(), "wearable": fixtures.wearable()}
    return spark.createDataFrame([(n, len(all_partitions(g))) for n, g in programs.items()], "program string, splits int")


@query("plan_bandwidth", "SELECT * FROM (VALUES ('merge', 3.0::DOUBLE), ('join', 1.0), ('filter', 0.5), ('block', 1000.0 / 120)) t(operator, rate)")
def plan_bandwidth(spark, sf_dir):
    return spark.createDataFrame([(n, float(depart_rate(*at))) for n, at in fixtures.departures().items()], "operator string, rate double")


#: At 20.95 readings a second, 31 splits hold a stage whose utilisation is over the limit; service times as measured leave 96.
@query("plan_cost", "SELECT * FROM (VALUES ('too_much', 'viable', 0), ('wearable', 'passes', 96), ('wearable', 'overloaded', 31), ('wearable', 'survives', 0)) t(program, outcome, plans)")
def plan_cost_query(spark, sf_dir):
    tight = Options(max_utilisation=1.1102e-4, max_bandwidth=1760)
    loose = Options(max_utilisation=1.1102e-4, max_bandwidth=1e9)
    plans = plans_of(fixtures.wearable())
    passing = sum(plan_cost(p, loose) is not None for p in plans)
    rows = [
        ("too_much", "viable", len(list(viable_plans(fixtures.too_much())))),
        ("wearable", "passes", passing),
        ("wearable", "overloaded", len(plans) - passing),
        ("wearable", "survives", sum(plan_cost(p, tight) is not None for p in plans)),
    ]
    return spark.createDataFrame(rows, "program string, outcome string, plans int")


@query("plan_staged", E + ", m AS (SELECT user_id, seq, us, v * 2 AS v FROM e WHERE v IS NOT NULL AND v * 2 > 5000) SELECT user_id, seq, us, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS value FROM m")
def plan_staged(spark, sf_dir):
    """A program split into three stages, run one after another and joined by tables."""
    stream = events(spark, sf_dir, key=("user_id",)).data()
    g = chain(_source(stream), _n(Kind.MAP, _double), _n(Kind.FILTER, _over), _n(Kind.SCAN, fold="sum"), _n(Kind.SINK))
    parts = next(p for p in all_partitions(g) if len(p) == 3 and max(map(len, p)) == 2)
    return run_staged(g, parts, links_dir(spark)).df.select("user_id", "seq", micros().alias("us"), "value")


__all__ = ["ORACLES", "QUERIES"]
