"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the classes it links.

A document is the set of its distinct word n-grams (64-bit hashes of whole n-grams). Two documents
link when ``100 * |x & y| >= threshold * |x | y|``. Let T = ceil(threshold * n / 100): linked documents
share at least T n-grams of each, so in any common order of all n-grams the first ``n - T + l`` of both
share at least ``l``. Frequent n-grams come last in the order used here. Each document picks its own
``l``: a longer prefix costs index entries, but a candidate must then share more of it. The choice
minimises the cost estimated from a table of frequent n-grams; a pair must share min(l, l') prefix n-grams.
The smaller document of a pair (by size, then key) shares even ceil(2 * threshold * n / (100 + threshold)) of its
own, so of it only a shorter prefix counts: frequent n-grams that make up much of many documents stay out.

Work stays near linear in large groups of copies. Equal sets are one vertex. In a star round, each document is
verified against one leader: of the leaders of its prefix n-grams (the holder whose n-grams are the most frequent,
as those of an original are among its near copies), the one it shares most with. That settles groups of near copies.
All pairs of different classes that share enough prefix n-grams are verified then, except pairs under the same
leader h that need not be: x & y is at most min(|x & h|, |y & h|) within h, so unless that alone suffices, they must
share n-grams outside h, and these are joined by themselves. So no link is lost, and classes are exact.

Texts are read four times: for set names and frequent n-grams, for prefixes (one text of each set), and for the whole
sets of star pairs and of the others. Bit filters pick the texts and the n-grams that more than one set has in its prefix;
what a filter lets pass in error costs work but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters
from .filters import BitFilter
from .graph import components, relabel, roots
from .marks import dealt, filter_of, passing
from .runtime import Stash, fresh, pieces, texts_of
from .words import PLAIN_FOLDED, distinct, shingles

#: n-grams of one task that are counted at a time, and how many of its most frequent ones a task reports.
COUNTED, REPORTED = 1_000_000, 1 << 16
#: Size of the table of frequent n-grams; it only sets the order and the estimates, never the result.
FREQUENT = 400_000
#: A document asks for one shared prefix n-gram, or for so many that they are one in this number of its own.
MATCH_PARTS = (32, 16)
#: Other holders that an n-gram outside the table is taken to have, for the estimates.
BACKGROUND = 0.15
#: Percentage of similarity from which a leader is close enough to save its star pairs.
CLOSE = 40
#: A value that more than 1 in HOT rows have (and LEAST_HOT rows) is hot: there are at most HOT such values, so a table of them is broadcast.
HOT, LEAST_HOT = 10_000, 64
#: Members from which a class is kept from meeting itself n-gram by n-gram.
LARGE = 8


def _sets(batch: pa.RecordBatch, text: str, size: int) -> Iterator[np.ndarray]:
    for _, grams in shingles(texts_of(batch, text), PLAIN_FOLDED, size):
        yield distinct(grams)


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _packed(grams: np.ndarray) -> bytes:
    """The upper six bytes of each hash, in order: for comparing two sets, as good as eight."""
    return grams.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = raw.reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, how many in each row) of a column of packed hashes."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2] if len(column) else None
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return _unpacked(raw), np.diff(at) // 6


def _first_pass(size: int):
    """A row (id, mark, key, n) for each document, and rows (gram, times) of n-grams that different sets of the task share."""

    def run(batches):
        seen, held, rows = set(), [], 0
        values, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        names, id_type = ["id", "mark", "key", "n", "gram", "times"], None

        def fold():
            nonlocal values, counts, held, rows
            v, c = np.unique(np.concatenate(held), return_counts=True)
            c2 = c > 1
            v, c = np.concatenate((values, v[c2])), np.concatenate((counts, c[c2]))
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, int)
            values, counts = v[first], np.add.reduceat(c, first) if len(v) else c
            if len(values) > 4 * REPORTED:
                top = np.sort(np.argpartition(-counts, 4 * REPORTED)[: 4 * REPORTED])
                values, counts = values[top], counts[top]
            held, rows = [], 0

        for batch in pieces(batches):
            keys, ns = [], []
            for grams in _sets(batch, "text", size):
                ns.append(len(grams))
                keys.append(_key(grams) if len(grams) else None)
                if len(grams) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(grams)
                    rows += len(grams)
                    if rows > COUNTED:
                        fold()
            id_type, none = batch.column(0).type, pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), none, none], names)
        if held:
            fold()
        if len(values):
            top = np.argsort(-counts, kind="stable")[:REPORTED]
            none = pa.nulls(len(top), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(top), id_type), none, none, none, pa.array(values[top].view(np.int64)), pa.array(counts[top])], names)

    return run


def frequent_grams(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of n-grams found often, ``FREQUENT`` at most."""
    top = found.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 2").orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    grams = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top.column("n").to_numpy().astype(np.int64)[order]


def _prefix(grams: np.ndarray, threshold: int, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The n-grams to index, how many of them a partner must share, and the mean count of all n-grams."""
    n = len(grams)
    need = -(-threshold * n // 100)
    base = n - need + 1
    order, found = grams, np.empty(0, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        hit = often[at] == grams
        if hit.any():
            c = counts[at[hit]]
            by = np.argsort(c, kind="stable")
            order, found = np.concatenate((grams[~hit], grams[hit][by])), c[by]
    rare = n - len(found)
    best, cost = 1, None
    for match in (1, *(n // part for part in MATCH_PARTS if n >= 2 * part)):
        length = base + match - 1
        load = BACKGROUND * length + int(found[: max(0, length - rare)].sum())
        now = length + n * load / match  # a candidate costs its whole set, n entries
        if cost is None or now < cost:
            best, cost = match, now
    return order[: base + best - 1], best, float(found.sum()) / n


def _indexer(size: int, threshold: int, often, wanted):
    """(key, n, match, weight, prefix) of the wanted texts; the prefix is packed, its first n-grams are the rarest."""

    def run(batches):
        grams_often, counts = often.value
        seen = set()
        for batch in pieces(_wanted(batches, wanted.value)):
            out = []
            for grams in _sets(batch, "text", size):
                if len(grams) and (key := _key(grams)) not in seen:
                    seen.add(key)
                    prefix, match, weight = _prefix(grams, threshold, grams_often, counts)
                    out.append((key, len(grams), match, weight, _packed(prefix)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["key", "n", "match", "weight", "prefix"])

    return run


def _wanted(batches, marks: BitFilter):
    """Of batches of (mark, text), the rows whose mark passes."""
    for batch in batches:
        ok = marks.passes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if ok.any():
            yield batch.filter(pa.array(ok))


def _prefix_values(batch: pa.RecordBatch) -> np.ndarray:
    return _flat(batch.column(0))[0]


def _thinner(bits, threshold: int):
    """Of each prefix, the n-grams that pass the filter, and how many of these are in the prefix that the smaller of two documents has."""

    def run(batches):
        for batch in pieces(batches):
            flat, lengths = _flat(batch.column(4))
            ok = bits.value.passes(flat)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            n, match = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            small = n + (-2 * threshold * n) // (100 + threshold) + match
            early = np.bincount(row[ok], place[ok] < small[row[ok]], batch.num_rows).astype(np.int32)
            held = np.bincount(row[ok], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), pa.array((flat[ok] >> np.uint64(16)).view(np.int64)))
            rows = pa.RecordBatch.from_arrays([*batch.columns[:4], lists, pa.array(early)], ["key", "n", "match", "weight", "grams", "early"])
            yield rows.filter(pa.array(held > 0))

    return run


def _set_rows(size: int, wanted):
    def run(batches):
        seen = set()
        for batch in pieces(_wanted(batches, wanted.value)):
            keys, sets = [], []
            for grams in _sets(batch, "text", size):
                if len(grams) and (key := _key(grams)) not in seen:
                    seen.add(key)
                    keys.append(key), sets.append(_packed(grams))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "grams"])

    return run


def _linked(threshold: int):
    """(a, b, linked, both, rest) of pairs; rest: what of b is not in a, if the two are close."""

    def run(batches):
        for batch in pieces(batches):
            linked, shared, rest = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (_unpacked(np.frombuffer(v.as_buffer(), np.uint8)) for v in (x, y))
                inside = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                both = int(inside.sum())
                either = len(x) + len(y) - both
                linked.append(100 * both >= threshold * either), shared.append(both)
                rest.append((y[~inside] >> np.uint64(16)).view(np.int64) if 100 * both >= CLOSE * either else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(shared, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "linked", "both", "rest"])

    return run


def hot(counts: DataFrame, n: str, total: int) -> DataFrame:
    """Of a table with a row for each value and the number of its rows, the hot ones: ``HOT`` at most."""
    return counts.where(F.col(n) > max(LEAST_HOT, total // HOT))


def even_join(rows: DataFrame, table: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row for each value of ``on`` and the number ``n`` of its rows (dropped): hot values by broadcast, the rest by shuffle."""
    many = hot(table, n, total).drop(n)
    few = rows.join(F.broadcast(many.select(on)), on, "left_anti").join(table.drop(n), on)
    return rows.join(F.broadcast(many), on).unionByName(few)


def across_classes(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (columns of x, those of y) of rows that agree on ``on`` and differ in class (``ca``, ``cb``), without any row meeting its own class.

    y's classes are among x's. The classes of a group are numbered; two rows meet at the uppermost bit where the
    numbers of their classes differ, so a row is repeated for each bit of the largest number.
    """
    of = Window.partitionBy(*on)
    classes = x.select(*on, F.col("ca").alias("c")).distinct()
    ranked = classes.withColumn("k", F.count("*").over(of)).withColumn("r", F.row_number().over(of.orderBy("c")) - 1).where("k > 1")
    bits = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("k") - 1)) - 1)))
    bits = bits.select(*on, "c", "bit", F.expr("(shiftright(r, bit) & 1)").alias("side"), F.expr("shiftright(r, bit + 1)").alias("above"))
    left = x.withColumnRenamed("ca", "c").join(bits, [*on, "c"]).withColumnRenamed("c", "ca")
    right = y.withColumnRenamed("cb", "c").join(bits, [*on, "c"]).withColumnRenamed("c", "cb").withColumn("side", 1 - F.col("side"))
    return left.join(right, [*on, "bit", "above", "side"])


def mark_of(id_: Column, text: Column) -> Column:
    """A name for a row by its id and text."""
    return F.xxhash64(id_, text.cast("string"))


class NgramJoin:
    """Links documents by n-gram Jaccard similarity.

    ``threshold`` is a percentage. ``classes`` gives a row per input row: id, n_shingles, component_id
    (the smallest id that links lead to; ids compare by their own order). Null or wordless texts have
    empty sets and stay alone, as their own component. Null ids take no part in the minimum, unless all ids are null.
    Repeated rows and repeated ids are rows of their own; other columns are ignored; an
    empty table gives no rows. Texts are compared whole, whatever their length; equal similarity at the threshold links.
    """

    def __init__(self, size: int = 5, threshold: int = 75):
        self.size, self.threshold = size, threshold

    def classes(self, docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
        index = self.index(docs, id_, text)
        return index.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "component_id")

    def index(self, docs: DataFrame, id_: str, text: str) -> DataFrame:
        """(id, mark, n, key, component_id, first) of each row; mark names the row's id and text, key its set (null if it is empty) and first the mark of its class's first row, by id (null last), key and mark."""
        spark = docs.sparkSession
        stash, sc = Stash(spark, "ngram-join"), spark.sparkContext
        id_type = docs.schema[id_].dataType
        own = docs.select(F.col(id_).alias("id"), mark_of(F.col(id_), F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
        longs = [T.StructField(c, T.LongType()) for c in ("mark", "key", "n", "gram", "times")]
        first = stash.put("first", own.mapInArrow(_first_pass(self.size), T.StructType([T.StructField("id", id_type), *longs])))
        rows = first.where("n is not null").select("id", "mark", "key", "n")
        often = sc.broadcast(frequent_grams(first.where("gram is not null")))
        low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("low")
        nodes = rows.where("key is not null").groupBy("key").agg(low, F.max("n").alias("n"), F.count("*").alias("copies"))
        nodes = stash.put("nodes", nodes.select("key", F.col("low.id").alias("low"), F.col("low.mark").alias("mark"), "n", "copies"))
        sets, grams, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()

        texts = own.select("mark", "text")
        shared = self._shared(texts, nodes.select("mark"), sets, grams, often, stash)
        labels = stash.put("labels", self._labels(texts, shared, nodes, stash))
        often.destroy()
        stash.drop("shared", "stars", "verified-stars", "held", "pairs")

        named = stash.put("named", nodes.drop("n").join(labels, "key", "left"))
        linked = named.where("comp is not null")
        least = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key", "mark")).alias("least")
        lows = linked.groupBy("comp").agg(least, F.count("*").alias("members"))
        lows = lows.select("comp", F.col("least.low").alias("component_id"), F.col("least.mark").alias("first"), "members")
        alone = named.where("comp is null").select("key", F.col("low").alias("component_id"), F.col("mark").alias("first"), "copies")
        linked = even_join(linked.select("key", "comp", "copies"), lows, "comp", "members", sets).select("key", "component_id", "first", "copies")
        found = stash.put("found", alone.union(linked))
        stash.drop("nodes", "labels", "named")
        full = even_join(rows.where("key is not null"), found, "key", "copies", total).select("id", "mark", "n", "key", "component_id", "first")
        return full.union(rows.where("key is null").select("id", "mark", "n", "key", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("first")))

    def _shared(self, texts: DataFrame, marks: DataFrame, sets: int, grams: int, often, stash: Stash) -> DataFrame:
        """(key, n, match, weight, grams, early) of each set: the prefix n-grams that more than one set has in its prefix (and few others)."""
        sc = texts.sparkSession.sparkContext
        wanted = sc.broadcast(filters.build(marks, filters.longs, sets))
        indexed = texts.mapInArrow(_indexer(self.size, self.threshold, often, wanted), "key long, n long, match int, weight double, prefix binary")
        indexed = stash.put("indexed", indexed)
        wanted.destroy()
        bits = sc.broadcast(filters.build(indexed.select("prefix"), _prefix_values, grams, 0.5, twice=True))
        out = stash.put("shared", indexed.mapInArrow(_thinner(bits, self.threshold), "key long, n long, match int, weight double, grams array<long>, early int"))
        bits.destroy()
        stash.drop("indexed")
        return out

    def _labels(self, texts: DataFrame, shared: DataFrame, nodes: DataFrame, stash: Stash) -> DataFrame:
        """(key, comp) of all keys that have a link."""
        stars = stash.put("stars", self._stars(shared))
        stars = stash.put("verified-stars", self._verified(texts, stars, nodes, stash))
        labels = self._star_labels(stars.where("linked"), stash)
        members = labels.groupBy("comp").agg(F.count("*").alias("members"))
        sized = even_join(labels, members.select("comp", (F.col("members") > LARGE).alias("large"), "members"), "comp", "members", labels.count())
        hubs = stars.where("rest is not null").select(F.col("b").alias("key"), F.col("a").alias("hub"), F.col("both").alias("held"))
        held = shared.drop("weight").join(sized, "key", "left").join(hubs, "key", "left")
        held = stash.put("held", held.withColumn("comp", F.coalesce("comp", "key")).withColumn("large", F.coalesce("large", F.lit(False))))
        stash.drop("shared")
        rest = stars.where("rest is not null").select(F.col("b").alias("key"), "rest").join(held.select("key", "n", "comp", "hub", "held"), "key")
        parts = [*self._crossings(held), self._beside_hubs(rest)]  # written one by one: fewer shuffles at a time
        light, heavy, beside = (stash.put(name, part) for name, part in zip(("light", "heavy", "beside"), parts, strict=True))
        pairs = stash.put("pairs", light.union(heavy).union(beside).distinct())
        stash.drop("light", "heavy", "beside")
        links = self._verified(texts, pairs, nodes, stash).where("linked")
        comps = held.select("key", "comp")
        links = links.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        more = components(links, stash, "pairs")
        rest_of = more.join(labels, "key", "left_anti")
        return relabel(labels, more).union(rest_of)

    def _star_labels(self, linked: DataFrame, stash: Stash) -> DataFrame:
        """(key, comp) of the ends of linked star pairs. A leader comes after those it leads in the order of weight and key, so there are no cycles."""
        led = linked.select(F.col("b").alias("key"), F.col("a").alias("up"))
        first = linked.select(F.col("a").alias("key")).distinct().join(led, "key", "left_anti")
        return roots(led.union(first.select("key", F.col("key").alias("up"))), stash, "stars")

    def _near(self) -> str:
        return f"100 * least(n, m) >= {self.threshold} * greatest(n, m)"

    def _enough(self, both: str) -> str:
        return f"{100 + self.threshold} * ({both}) >= {self.threshold} * (n + m)"

    def _stars(self, shared: DataFrame) -> DataFrame:
        """For each set at most one leader with which it shares prefix n-grams."""
        held = shared.select("key", "n", "match", "weight", F.explode("grams").alias("gram"))
        lead = held.groupBy("gram").agg(F.max(F.struct("weight", "key", "n")).alias("lead")).select("gram", F.col("lead.key").alias("a"), F.col("lead.n").alias("m"))
        near = held.drop("weight").join(lead, "gram").where(f"key <> a and {self._near()}")
        best = near.groupBy("key", "a").agg(F.count("*").alias("c"), F.min("match").alias("match")).where("c >= match").groupBy("key").agg(F.max(F.struct("c", "a")).alias("best"))
        return best.select(F.col("best.a").alias("a"), F.col("key").alias("b"))

    def _crossings(self, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of sets of different classes that share enough prefix n-grams, fit in size and may be similar by what a common leader shows.

        Rows of large classes meet those of other large classes by ``across_classes`` (the second table), and rows of small ones
        directly (the first): all that a pair shares is in one of the two.
        """
        x = held.select(F.explode("grams").alias("gram"), F.col("key").alias("a"), "n", F.col("match").alias("match_a"), F.col("comp").alias("ca"), F.col("hub").alias("ha"), F.col("held").alias("oa"), "large")
        early = F.explode(F.slice("grams", 1, F.col("early"))).alias("gram")
        y = held.where("early > 0").select(early, F.col("key").alias("b"), F.col("n").alias("m"), F.col("match").alias("match_b"), F.col("comp").alias("cb"), F.col("hub").alias("hb"), F.col("held").alias("ob"), "large")
        apart = f"(ha is null or hb is null or ha <> hb or {self._enough('least(oa, ob)')})"
        fits = f"(n > m or n = m and a > b) and ca <> cb and {self._near()} and {apart}"
        met = y.withColumn("large", F.explode(F.when(F.col("large"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        light = x.join(met, ["gram", "large"]).where(fits)
        heavy = across_classes(x.where("large").drop("large"), y.where("large").drop("large"), ["gram"]).where(fits)

        def enough(rows: DataFrame) -> DataFrame:
            both = rows.groupBy("a", "b").agg(F.count("*").alias("c"), F.least(F.first("match_a"), F.first("match_b")).alias("least"))
            return both.where("c >= least").select("a", "b")

        return enough(light), enough(heavy)

    def _beside_hubs(self, rest: DataFrame) -> DataFrame:
        """Pairs of sets of different classes under one leader that share enough n-grams outside it."""
        rows = rest.select("hub", F.explode("rest").alias("gram"), "key", "n", "comp", "held")
        x = rows.select("hub", "gram", F.col("key").alias("a"), "n", F.col("comp").alias("ca"), F.col("held").alias("oa"))
        y = rows.select("hub", "gram", F.col("key").alias("b"), F.col("n").alias("m"), F.col("comp").alias("cb"), F.col("held").alias("ob"))
        both = across_classes(x, y, ["hub", "gram"]).where(f"(n > m or n = m and a > b) and {self._near()}")
        both = both.groupBy("a", "b").agg(F.count("*").alias("s"), *[F.first(c).alias(c) for c in ("n", "m", "oa", "ob")])
        return both.where(self._enough("s + least(oa, ob)")).select("a", "b")

    def _verified(self, texts: DataFrame, pairs: DataFrame, nodes: DataFrame, stash: Stash) -> DataFrame:
        """What ``_linked`` says of the pairs, from the whole sets; of equal sets, the text with the lowest id is read.

        The pairs of a hot first end are dealt out, each share with a copy of its set.
        """
        sc = texts.sparkSession.sparkContext
        ends = stash.put("ends", pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes.select("key", "mark"), "key").select("mark"))
        wanted = sc.broadcast(filters.build(ends, filters.longs, ends.count()))
        stash.drop("ends")
        sets = texts.mapInArrow(_set_rows(self.size, wanted), "key long, grams binary").dropDuplicates(["key"])
        total = pairs.count()
        shares = hot(pairs.groupBy("a").agg(F.count("*").alias("pairs")), "pairs", total)
        shares = F.broadcast(shares.select("a", F.ceil(F.col("pairs") / max(LEAST_HOT, total // HOT)).cast("int").alias("shares")))
        few = pairs.join(shares, "a", "left_anti").join(sets.toDF("b", "grams_b"), "b").join(sets.toDF("a", "grams_a"), "a")
        many = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share")).join(sets.toDF("b", "grams_b"), "b")
        dealt = sets.toDF("a", "grams_a").join(shares, "a").select("a", "grams_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        names = ["a", "b", "grams_a", "grams_b"]
        full = few.select(names).union(many.join(dealt, ["a", "share"]).select(names))
        return full.mapInArrow(_linked(self.threshold), "a long, b long, linked boolean, both long, rest array<long>")


def keep_one(docs: DataFrame, join: NgramJoin, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with one row of each class kept: that with the smallest id (null last), then set key, then mark.

    Of rows with the same id and text, the first by their JSON stays. Documents with an empty set all stay, and an empty
    table stays empty. The columns come back unchanged, whatever others there are, maps included. Texts are not
    shuffled: bit filters of the rows that go, and of those that stay but pass the first filter, decide all but a few.
    """
    stash = Stash(docs.sparkSession, "keep-one")
    rows = join.index(docs, id_, text).groupBy("mark").agg(F.first("key").alias("key"), F.first("first").alias("first"), F.count("*").alias("copies"))
    empty = F.col("key").isNull()
    stays = F.when(empty, True).otherwise(F.col("first") == F.col("mark"))
    sorted_ = stash.put("sorted", rows.select("mark", F.when(empty, 1).otherwise(F.col("copies")).alias("copies"), stays.alias("stays")))
    out = sorted_.where("not stays or copies > 1").select("mark")
    gone = filter_of(out)
    beside = passing(sorted_.where("stays and copies = 1").select("mark"), gone).withColumn("again", F.lit(False))
    looked_up = stash.put("looked-up", beside.union(sorted_.where("stays and copies > 1").select("mark", F.lit(True))))
    stays, found, mark = dealt(docs, mark_of(F.col(id_), F.col(text)), gone, looked_up.select("mark"))
    again = fresh("__again", found.columns)
    found = found.join(looked_up.toDF(mark, again), mark)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    single = found.where(F.col(again)).groupBy(mark).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return stays.union(found.where(~F.col(again)).select(*docs.columns)).union(single)
