"""Operators across documents: joins, tiling, mixing, URL rules and the pipeline, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import filters
from rillflow.llm import ngram_join as nj
from rillflow.llm.decontamination import Decontamination, tiles
from rillflow.llm.graph import components
from rillflow.llm.mixing import SourceMix
from rillflow.llm.ngram_join import NgramJoin, keep_one
from rillflow.llm.runtime import Stash, pieces
from rillflow.llm.url_filters import PATTERNS, Rule, UrlFilter, address_rule

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "" if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t))


def grams(t):
    own = plain_words(t)
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()}


def brute_classes(rows):
    """(n, component) of each (id, text), by all pairs."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, n=90):
    """Originals, near copies in chains and stars, exact copies, a passage that many share, and short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 6)))
    passage = [word() for _ in range(20)]
    texts = []
    for i in range(n):
        kind = rnd.random()
        if i and kind < 0.5:
            own = texts[rnd.randrange(max(0, i - 12), i)].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                if own:
                    own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
        elif kind < 0.7:
            texts.append(" ".join(passage + [word() for _ in range(rnd.randrange(0, 12))]))
        else:
            texts.append(" ".join(word() for _ in range(rnd.choice([0, 1, 4, 5, 30, 60]))))
    ids = list(range(n))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = NgramJoin().classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(rows)


def test_ngram_join_with_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(nj, "COUNTED", 300)
    monkeypatch.setattr(nj, "FREQUENT", 10)
    rows = near_copies(4, 60)
    assert sorted(tuple(r) for r in NgramJoin().classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute_classes(rows)


def test_prefixes_share_enough():
    """Any two similar sets share min(match) n-grams of the longer's prefix and the shorter's early one."""
    rnd = np.random.default_rng(5)
    for _ in range(200):
        n = int(rnd.integers(1, 200))
        x = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        drop = rnd.random(len(x)) < rnd.random() * 0.15
        y = np.unique(np.concatenate([x[~drop], rnd.integers(0, 1 << 62, int(rnd.integers(0, 1 + n // 10))).astype(np.uint64)]))
        often = np.sort(rnd.choice(x, max(1, len(x) // 3), replace=False))
        counts = rnd.integers(4, 5000, len(often))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        if len(x) < len(y):
            x, y = y, x
        (px, mx, _), (py, my, _) = nj._prefix(x, 75, often, counts), nj._prefix(y, 75, often, counts)
        early = py[: len(y) + (-150 * len(y)) // 175 + my]
        assert len(np.intersect1d(px, early)) >= min(mx, my)


def test_ngram_join_on_odd_tables(spark):
    long = "word " * 50_000 + " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Solo"), (5, "sOLO"), (5, "solo"), (6, long), (7, long + " tail"), (None, "solo"), (8, "a b c d"), (9, "a b c d e")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, key string, n string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in NgramJoin().classes(df).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (8, 1, 8), (9, 1, 9)} <= got
    assert {c for i, _, c in got if i in (6, 7)} == {6}
    assert NgramJoin().classes(df.limit(0)).count() == 0
    kept = keep_one(df, NgramJoin())
    assert kept.schema == df.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id != 6) == [(1, None), (2, ""), (3, " \n"), (4, "Solo"), (8, "a b c d"), (9, "a b c d e")]


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "quite another text of words")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), NgramJoin())
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f"), (1, "quite another text of words")]


@pytest.mark.parametrize("seed", [4, 5])
def test_ngram_join_with_hot_leaders_and_large_classes(spark, monkeypatch, seed):
    for name, value in (("HOT", 5), ("LEAST_HOT", 2), ("LARGE", 1)):
        monkeypatch.setattr(nj, name, value)
    rows = near_copies(seed, 70)
    rows += [(1000 + i, rows[3][1]) for i in range(9)]
    assert sorted(tuple(r) for r in NgramJoin().classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()) == brute_classes(rows)


def test_rows_of_one_class_never_meet(spark):
    rnd = random.Random(3)
    rows = [(g, i, rnd.randrange(k)) for g, k in enumerate([1, 2, 3, 9, 16, 17]) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, c int")
    x, y = df.select("g", F.col("i").alias("a"), F.col("c").alias("ca")), df.where("i % 2 = 0").select("g", F.col("i").alias("b"), F.col("c").alias("cb"))
    got = sorted((r.g, r.a, r.b) for r in nj.across_classes(x, y, ["g"]).collect())
    assert got == sorted((g, i, j) for g, i, c in rows for h, j, d in rows if g == h and c != d and j % 2 == 0)


@pytest.mark.parametrize("twice", [False, True])
def test_bit_filters_pass_what_they_hold(spark, monkeypatch, twice):
    monkeypatch.setattr(filters, "PACKED", 500)
    monkeypatch.setattr(filters, "SLICE", 4)
    rnd = np.random.default_rng(2)
    values = rnd.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    rows = np.concatenate([values, np.repeat(values[:1000], 4)])
    rnd.shuffle(rows)
    held = filters.build(spark.createDataFrame([(int(v),) for v in rows], "h bigint").repartition(3), filters.longs, len(rows), 20, twice)
    assert held.passes(values[: 1000 if twice else 3000]).all()
    assert held.passes(rnd.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)).mean() < 0.05
    if twice:
        assert held.passes(values[1000:]).mean() < 0.05
    assert not filters.build(spark.range(0).select("id"), filters.longs, 0).passes(values).any()


def test_keep_one_of_any_table(spark):
    """Map columns, clashing names, rows that a filter takes for copies, and an empty table."""
    rows = [(i, f"text number {i // 3} of words and more words", {"k": i}, i, i) for i in range(60)] + [(0, "text number 0 of words and more words", {"k": 0}, 1, 1)] * 2 + [(99, None, None, 0, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string, int>, __mark int, __Sort int")
    kept = keep_one(df, NgramJoin())
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 60, 3), 99, 99]
    assert {tuple(r.m.items()) for r in kept.where("doc_id = 0").collect()} == {(("k", 0),)}
    assert keep_one(df.limit(0), NgramJoin()).count() == 0


def test_keep_one_looks_up_what_passes_both_filters(spark, monkeypatch):
    monkeypatch.setattr(filters, "BITS_EACH", 0)
    monkeypatch.setattr(filters.BitFilter, "passes", lambda self, v: np.ones(len(v), bool))
    rows = near_copies(6, 60) + [(7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lows = {c for d, n, c in brute_classes(rows) if n}
    assert sorted(r.doc_id for r in keep_one(df, NgramJoin()).collect()) == sorted([*lows, *[d for d, n, c in brute_classes(rows) if not n]])


def test_long_texts_go_in_small_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (3 << 20)] * 5 + ["y"] * 2500 + ["z" * (9 << 20)])], ["t"])
    parts = list(pieces(iter([batch])))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 2 << 20 for p in parts) and max(p.num_rows for p in parts) <= 1000


def test_the_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from rillflow.llm import runtime

    none = SimpleNamespace(get=lambda k, d=None: None)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: none, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(cluster)


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rnd.randrange(20), 200 + rnd.randrange(20)) for _ in range(15)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.key: r.comp for r in components(df, Stash(spark, "t"), "t").collect()}
    up = {v: v for e in edges for v in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(up[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({up[v] for v in got})


# Decontamination


def brute_tiles(doc, item, size):
    """Greedy tiling by looking for the longest unmarked common run, again and again."""
    x, y, out = [None] * len(doc), [None] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and x[i + n] is None and y[j + n] is None:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            x[best[0] + k] = y[best[1] + k] = 1


@pytest.mark.parametrize("seed", range(8))
def test_tiling_equals_brute_force(seed):
    rnd = random.Random(seed)
    doc, item = [rnd.randrange(3) for _ in range(40)], [rnd.randrange(3) for _ in range(25)]
    got = tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
    expected = brute_tiles(doc, item, 3)
    assert [t[2] for t in got] == [t[2] for t in expected] and got == expected


def test_tiling_of_repetitive_texts_is_bounded():
    import time
    import tracemalloc

    doc, item = np.full(100_000, 7, np.uint64), np.full(20_000, 7, np.uint64)
    began = time.time()
    tracemalloc.start()
    assert tiles(doc, item, 4) == [(0, 0, 20_000)]
    phrase = np.arange(4, dtype=np.uint64)
    often = lambda n, at: np.concatenate([np.append(phrase, np.uint64(at + k)) for k in range(n)])
    assert len(tiles(often(3000, 10), often(2000, 10_000), 4)) == 2000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert time.time() - began < 20


def test_many_items_with_a_common_seed(spark):
    import time

    from rillflow.llm.decontamination import _search

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [" ".join(["as is well known", *[word() for _ in range(12)]]) for _ in range(10_000)]
    seeds = Decontamination()._seeds([i.encode() for i in items])
    texts = [f"as is well known {word()} {word()}".encode()] * 200 + [items[77].encode()]
    began = time.time()
    found = [[f.item for f in found] for found in _search(seeds, texts, 4, 0.5)]
    assert found[-1] == [77] and not any(found[:-1]) and time.time() - began < 20


def test_decontamination(spark, monkeypatch):
    from rillflow.llm import decontamination

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(20)) for _ in range(6)] + ["too short", None, ""]
    parts = items[0].split()
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [
        (1, fill(50) + " " + items[0].upper() + ". " + fill(30)),
        (2, " ".join([*parts[10:], fill(5), *parts[:10]])),
        (3, fill(80)),
        (4, " ".join(parts[:6]) + " " + fill(40)),
        (5, None),
        (6, items[1] + " " + items[2]),
        (6, items[1] + " " + items[2]),
        (None, items[3]),
    ]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    expected = [(1, 0), (2, 0), (6, 1), (6, 1), (6, 2), (6, 2), (None, 3)]
    for block in (1 << 20, 100):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = [(r.doc_id, r.item_id) for r in Decontamination().matches(docs.drop("item_id"), bench).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
        clean = Decontamination().clean(docs, bench)
        assert clean.schema == docs.schema and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    twice = bench.union(bench.where("item_id = 0"))
    assert sorted((r.doc_id, r.item_id) for r in Decontamination().matches(docs.drop("item_id").where("doc_id < 4"), twice).collect()) == [(1, 0), (1, 0), (2, 0), (2, 0)]
    match = next(r for r in Decontamination().matches(docs.drop("item_id"), bench).collect() if r.doc_id == 2)
    assert match.n_tiles == 2 and match.covered == 20 and match.longest == 10
    assert Decontamination().matches(docs, bench.limit(0)).count() == 0 and Decontamination().clean(docs.limit(0), bench).count() == 0


# Mixing


def brute_targets(sizes, weights, share, most):
    total, capped = share * sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        each = rest / sum(weights[i % len(weights)] for i in open_) if open_ else 0
        over = [i for i in open_ if each * weights[i % len(weights)] > most * sizes[i] + 1e-9]
        if not over:
            return [capped.get(i, each * weights[i % len(weights)]) for i in range(len(sizes))]
        capped |= {i: most * sizes[i] for i in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed, monkeypatch):
    from rillflow.llm import mixing

    monkeypatch.setattr(mixing, "PARTS", 10)
    rnd = random.Random(seed)
    names = ["b", "a", None, "ç", "Z", "empty"]
    rows = [(i, " ".join(["w"] * (0 if s == "empty" else rnd.randrange(0, 40))) if rnd.random() > 0.05 else None, s, "x") for i in range(400) for s in [rnd.choices(names, [8, 2, 1, 1, 1, 1])[0]]]
    rows += rows[:3] + [(None, "w w w", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    out = SourceMix().weigh(df).collect()
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(plain_words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, brute_targets([size[s] for s in order], (3, 1, 2), 1.5, 2), strict=True))
    taken = {}
    for r in out:
        assert r["__mix_target"] == pytest.approx(target[r.source]) and r["__mix_source_size"] == size[r.source] and 0 <= r["__mix_copies"] <= 2
        taken[r.source] = taken.get(r.source, 0) + r["__mix_size"] * r["__mix_copies"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 45 for s in order)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = SourceMix().weigh(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    emitted = SourceMix().emit(df)
    assert emitted.columns == ["doc_id", "text", "source", "copy"] and emitted.count() == sum(r["__mix_copies"] for r in out)
    assert SourceMix().weigh(df.limit(0)).count() == 0
    assert {r["__mix_copies"] for r in SourceMix().weigh(df.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_mixing_takes_the_same_rows_however_many_parts(spark, monkeypatch):
    from rillflow.llm import mixing

    rnd = random.Random(8)
    rows = [(i, "w " * rnd.choice([3, 5, 5, 6, 7, 20]), rnd.choice(["a", "a", "a", "b", None])) for i in range(1500)]
    df = spark.createDataFrame([*rows, (None, "w w w w w", "a")], "doc_id bigint, text string, source string")
    taken = lambda: sorted((str(r.doc_id), r["__mix_copies"]) for r in SourceMix().weigh(df).collect())
    one = taken()
    monkeypatch.setattr(mixing, "PARTS", 1)
    assert taken() == one and len(one) == 1501
    names = df.withColumn("doc_id", F.format_string("n%s", "doc_id"))
    many = SourceMix().weigh(names).collect()
    monkeypatch.setattr(mixing, "PARTS", 200)
    assert sorted(map(str, many)) == sorted(map(str, SourceMix().weigh(names).collect()))


def test_mixing_is_systematic_sampling(spark):
    """Against a plain running sum in the same order, with the same offset."""
    rnd = random.Random(5)
    rows = [(i if i % 9 else None, "w " * rnd.choice([0, 3, 5, 5, 40, 3000]), rnd.choice(["a", "a", "b", "c"])) for i in range(300)]
    rows += [(7, "w w w", "a")] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {}
    for r in SourceMix().weigh(df).collect():
        got.setdefault((r.doc_id, r.text, r.source), []).append(r["__mix_copies"])
    each = {r.source: r["__mix_target"] / r["__mix_source_size"] for r in SourceMix().weigh(df).collect()}
    want = {}
    for s in each:
        u = (int(hashlib.md5(f"0:={s}".encode()).hexdigest()[:4], 16) + 0.5) / 65536
        own = sorted(((len(t.split()), hashlib.md5(f"{'' if d is None else d}:{t}".encode()).hexdigest()[:12], d, t) for d, t, x in rows if x == s), key=lambda r: r[:2])
        for k, (_, _, d, t) in enumerate(own):
            want.setdefault((d, t, s), []).append(math.floor(u + (k + 1) * each[s]) - math.floor(u + k * each[s]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_mixing_takes_any_column_names(spark):
    names = ["place", "before", "start", "each", "parts", "u", "size", "target", "name", "limit", "copies"]
    rows = [(i, "w " * (i % 7), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = SourceMix().emit(df)
    assert out.columns == [*df.columns, "copy"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert SourceMix().emit(df.limit(0)).count() == 0


def test_long_texts_are_mixed_and_tiled_whole(spark):
    long = "word " * 400_000
    item = " ".join(f"item{i}" for i in range(40))
    rows = [(1, long, "a"), (2, f"{long} {item}", "a"), (3, "x y z", "a"), (4, None, "b"), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id: r["__mix_size"] for r in SourceMix().weigh(df).collect()} == {1: 400_000, 2: 400_040, 3: 3, 4: 0, 5: 0}
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [(r.doc_id, r.covered) for r in Decontamination().matches(df, bench).collect()] == [(2, 40)]


def test_stages_carry_any_column_names(spark, tmp_path):
    """Every stage over a table with nulls, repeated rows, odd column names and a map, and over an empty one."""
    import corpus_pipeline

    names = ["mark", "key", "id", "gram", "words", "place", "hash", "__mark", "size", "start", "u"]
    schema = SCHEMA + ", " + ", ".join(f"{n} string" for n in names) + ", m map<string, int>"
    texts = [None, "", "one", "a b c d e f g", "a b c d e f g", "password = abcdefgh12", "word " * 100_000]
    rows = [(i, t, "en", None if i % 3 == 0 else "s", 1, *[f"{n}{i}" for n in names], {"k": i}) for i, t in enumerate(texts)] + [(None, "a b c d e f g", None, None, None, *[None] * len(names), None)]
    for rows_, folder in ((rows + rows[2:4], "full"), ([], "none")):
        top = tmp_path / folder
        spark.createDataFrame(rows_, schema).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([(2, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
        spark.createDataFrame([(1, "x y z w v")], "item_id bigint, text string").write.parquet(str(top / "benchmark.parquet"))
        docs = spark.read.parquet(str(top / "documents.parquet"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, stage(spark, docs, str(top))
            assert docs.columns == [*before.columns, "copy"][: len(before.columns) + (k == 4)]
            docs.write.parquet(str(top / name))
            docs = spark.read.parquet(str(top / name))
            for r in docs.collect():
                assert r.doc_id is None or [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and r.m == {"k": r.doc_id}
        assert docs.count() == 0 or {r.doc_id for r in spark.read.parquet(str(top / "ngram_jaccard_join")).collect()} == {0, 1, 2, 3, 5, 6}


# URL filters


def test_url_filters(spark, monkeypatch):
    from rillflow.llm import url_filters

    rules = (*[address_rule(*a) for a in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))], *PATTERNS)
    cases = {
        "https://M.Example.ORG/en/17?x#y": ("m.example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/ES/1": ("example.org", "/ES/1", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com/fr/login": ("a.com", "/fr/login", "com/fr/", "allow"),
        "http://a.com/fr": ("a.com", "/fr", None, "allow"),
        "http://a.org?q=/": ("a.org", "", None, "allow"),
        "http://a.net/x/login?u=1": ("a.net", "/x/login", None, "block"),
        "http://ads.a.net/x": ("ads.a.net", "/x", None, "block"),
        "http://heads.net/loginx": ("heads.net", "/loginx", None, "allow"),
        "http://a.net/f.exe": ("a.net", "/f.exe", None, "block"),
        "http://a.net/x?a=1&sid=2": ("a.net", "/x", None, "block"),
        "http://a.net/X/LOGIN": ("a.net", "/X/LOGIN", None, "block"),
        "http://a.net/F.Exe": ("a.net", "/F.Exe", None, "block"),
        "http://a.net/wp-login.php": ("a.net", "/wp-login.php", None, "block"),
        "http://a.net/wp/x-login-y": ("a.net", "/wp/x-login-y", None, "allow"),
        "http://a.net/shop/Add_To_Cart?x": ("a.net", "/shop/Add_To_Cart", None, "block"),
        "http://a.net/" + "x/" * 200_000 + "login": ("a.net", "/" + "x/" * 200_000 + "login", None, "block"),
        "http://" + "a." * 100_000 + "org/": ("a." * 100_000 + "org", "/", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "x://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = list(enumerate(cases)) + [(0, next(iter(cases)))]
    df = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id bigint, url string, host string")
    expected = sorted((i, *cases[u]) for i, u in rows)
    for limit in (2000, 0):
        monkeypatch.setattr(url_filters, "IN_ROW", limit)
        got = UrlFilter(rules).judge(df)
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert UrlFilter(()).judge(df).where("verdict <> 'allow'").count() == 0 and UrlFilter(rules).judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        UrlFilter((Rule("any", "block", ".*", ()),))
    assert UrlFilter(rules).index({"example": 9, "org": 1, "en": 5})["org"]
    filed = UrlFilter(rules).index({"wp": 3, "login": 90, "add": 5, "to": 70, "cart": 2})
    names = {t: {UrlFilter(rules).rules[k].name for k in ks} for t, ks in filed.items()}
    assert "path:wp-login" in names["wp"] and "path:add-to-cart" in names["cart"] and "to" not in names


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    common = ["".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    fill = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    item = fill(25)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        rows.append((i, fill(60) + " grolk frimp" * toxic, "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[1][1], "en", "s0", 0), (301, fill(20) + " " + item, "en", "s1", 0), (302, fill(30) + " password = hunter2hunter2", "en", "s2", 0), (303, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [set(r[0] for r in rows)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] - kept[1] == {i for i in range(240) if i % 6 == 0}
    assert kept[1] - kept[2] == {300} and kept[2] - kept[3] == {301} and kept[3] == kept[4]
    secret = spark.read.parquet(str(tmp_path / "secret_scan")).where("doc_id = 302").first()
    assert secret.text.endswith(" [SECRET]") and secret.n_chars == len(secret.text)
    mixed = spark.read.parquet(str(tmp_path / "source_mixing"))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, mixed.collect()))


def test_nothing_else_needs_this_package():
    import os

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(top, "rillflow")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                assert not re.search(r"(from|import) .*\bllm\b", open(os.path.join(folder, f)).read()), f
