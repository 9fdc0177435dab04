"""Benchmark decontamination by greedy string tiling.

Texts become sequences of lower-cased runs of letters and digits. A benchmark item's runs of
``MIN_MATCH`` words are seeds. A document whose seeds could cover enough of an item is tiled against it:
windows of ``MIN_MATCH`` words, hashed as they roll along both sequences, give common runs; the longest
run is marked, what other runs lose to the marks is cut off, and so on until no unmarked run of
``MIN_MATCH`` words is common. Tiles cover an item in any order, so a reordered passage is found as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .marks import without
from .runtime import Stash, pieces, small_batches, texts_of
from .words import ALNUM_FOLDED, shingles

#: Bytes of benchmark text whose seeds are sent to the executors at a time; a larger benchmark goes in blocks.
BLOCK_BYTES = 8 << 20
_BASE = 0xD6E8FEB86659FD93


def _hits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y."""
    y = np.unique(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


class _Rolling:
    """Karp-Rabin sums of a sequence: the hash of any window of it, and whether the window is free of marks."""

    def __init__(self, values: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.values, self.inverse = values, inverse
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * powers[: len(values)], dtype=np.uint64)))
        self.taken = np.zeros(len(values), bool)
        self.mark()

    def mark(self) -> None:
        self.before = np.concatenate(([0], np.cumsum(self.taken)))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked windows of a length."""
        n = len(self.values) - length + 1
        at = np.flatnonzero(self.before[length:] == self.before[:n]) if n > 0 else np.empty(0, np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def tiles(doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences: (place in doc, place in item, length), longest first.

    Of equally long runs that in front of the document, then of the item, is marked first. The greatest length of a
    common unmarked run is found by bisection over window lengths (a run has shorter ones in it), and all runs of that
    length are marked at once, so pairs of places are never listed: memory is that of the two sequences, however often a
    run repeats, and there are as many rounds as lengths of tiles.
    """
    if len(doc) < size or len(item) < size:
        return []
    n = max(len(doc), len(item))
    powers, inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    x, y = _Rolling(doc, powers, inverse), _Rolling(item, powers, inverse)
    out, most = [], min(len(doc), len(item))
    while most >= size:
        (_, hx), (_, hy) = x.windows(size), y.windows(size)
        if not _hits(hx, hy).any():
            break
        low = size  # the greatest length known to have a common run; most: the greatest that may have one
        while low < most:
            middle = (low + most + 1) // 2
            (_, hx), (_, hy) = x.windows(middle), y.windows(middle)
            if _hits(hx, hy).any():
                low = middle
            else:
                most = middle - 1
        (ix, hx), (iy, hy) = x.windows(low), y.windows(low)
        order = np.argsort(hy, kind="stable")
        hy, iy = hy[order], iy[order]
        hit = _hits(hx, hy)
        groups = dict(zip(hx[hit].tolist(), np.searchsorted(hy, hx[hit]).tolist(), strict=True))
        for i, h in zip(ix[hit].tolist(), hx[hit].tolist(), strict=True):
            if x.taken[i] or x.taken[i + low - 1]:
                continue
            k = groups[h]
            while k < len(hy) and int(hy[k]) == h and (y.taken[iy[k]] or y.taken[iy[k] + low - 1]):
                k += 1
            groups[h] = k
            if k < len(hy) and int(hy[k]) == h and np.array_equal(doc[i : i + low], item[iy[k] : iy[k] + low]):
                x.taken[i : i + low] = y.taken[iy[k] : iy[k] + low] = True
                out.append((i, int(iy[k]), low))
        x.mark(), y.mark()
        most = low - 1
    return out


@dataclass
class Found:
    item: int
    covered: int
    n_tiles: int
    longest: int


def _search(seeds: dict, texts: list[bytes], size: int, coverage: float):
    """For each text the list of Found."""
    bits, grams, start, item_of, place_of, items = (seeds[k] for k in ("bits", "grams", "start", "item", "place", "items"))
    for words, runs in shingles(texts, ALNUM_FOLDED, size):
        out: list[Found] = []
        maybe = np.flatnonzero(bits[runs >> np.uint64(44)]) if len(words) >= size and len(grams) else []
        if len(maybe):
            hits = np.unique(runs[maybe])
            at = np.minimum(np.searchsorted(grams, hits), len(grams) - 1)
            at = at[grams[at] == hits]
            n = start[at + 1] - start[at]
            total = int(n.sum())
            if total:
                rows = np.repeat(start[at], n) + np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                own, place = item_of[rows], place_of[rows]
                lengths = seeds["lengths"]
                order = np.argsort(own, kind="stable")
                own, place = own[order], place[order]
                ids, first, held = np.unique(own, return_index=True, return_counts=True)
                enough = size * held >= coverage * lengths[ids]  # as many words as the seeds could cover
                for item, a, b in zip(ids[enough], first[enough], (first + held)[enough], strict=True):
                    target = items[item]
                    reach = np.zeros(len(target) + 1, np.int64)
                    np.add.at(reach, place[a:b], 1)
                    np.add.at(reach, place[a:b] + size, -1)
                    if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(target):
                        continue
                    found = tiles(words, target, size)
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(target):
                        out.append(Found(int(item), covered, len(found), found[0][2]))
        yield out


class Decontamination:
    """Finds documents that hold most of a benchmark item.

    ``matches`` gives a row per document row and item whose tiles cover at least ``coverage`` of the item's
    words: id, item id, n_words of the item, covered, coverage, n_tiles, longest, contaminated (true).
    ``clean`` gives the documents without any, all columns unchanged, whatever their names. Null texts and items, and
    items of fewer than ``min_match`` words, match nothing. Repeated rows, ids and items each count; rows with a null
    id are searched like others; further columns are ignored. Whole texts are tiled, whatever their length; ties between
    tiles are settled by place. Empty tables give no matches. The benchmark goes in blocks of about ``BLOCK_BYTES``, and
    only one block at a time is held by the driver and sent out; documents are read once a block.
    """

    def __init__(self, min_match: int = 4, coverage: float = 0.5):
        self.min_match, self.coverage = min_match, coverage

    def blocks(self, benchmark: DataFrame, item: str, text: str):
        """(seeds, item ids, how often each row is repeated, whether it is the only block) of one block after another."""
        rows = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
        rows = rows.groupBy("item", "text").agg(F.count("*").alias("times"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-total // BLOCK_BYTES))
        for k in range(n):
            block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").toArrow().combine_chunks()
            ids, times = (block.column(c).combine_chunks() if block.num_rows else pa.array([], block.schema.field(c).type) for c in ("item", "times"))
            yield self._seeds(texts_of_table(block)), ids, times, n == 1

    def _seeds(self, texts: list[bytes]) -> dict:
        items, grams, own, place = [], [], [], []
        for k, (words, runs) in enumerate(shingles(texts, ALNUM_FOLDED, self.min_match)):
            items.append(words.copy())
            if len(words) >= self.min_match:
                grams.append(runs), own.append(np.full(len(runs), k)), place.append(np.arange(len(runs)))
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(g, kind="stable")
        values, first = np.unique(g[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[values >> np.uint64(44)] = True
        flat = lambda parts: np.concatenate(parts)[order] if parts else np.empty(0, np.int64)
        lengths = np.array([len(i) for i in items], np.int64)
        return {"bits": bits, "grams": values, "start": np.append(first, len(g)).astype(np.int64), "item": flat(own), "place": flat(place), "items": items, "lengths": lengths}

    def matches(self, docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
        small_batches(docs.sparkSession)
        sc, stash, out = docs.sparkSession.sparkContext, None, None
        own = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
        fields = [(id_, docs.schema[id_].dataType), (item, benchmark.schema[item].dataType), ("n_words", T.LongType()), ("covered", T.LongType()), ("coverage", T.DoubleType()), ("n_tiles", T.LongType()), ("longest", T.LongType()), ("contaminated", T.BooleanType())]
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        for k, (seeds, ids, times, only) in enumerate(self.blocks(benchmark, item, item_text)):
            held = sc.broadcast((seeds, ids, times))
            part = own.mapInArrow(_matcher(held, self.min_match, self.coverage, schema.names), schema)
            if only:
                return part
            stash = stash or Stash(docs.sparkSession, "decontamination")
            part = stash.put(f"block{k}", part)
            held.destroy()
            out = part if out is None else out.union(part)
        return out

    def clean(self, docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
        small_batches(docs.sparkSession)
        sc, stash, found = docs.sparkSession.sparkContext, None, None
        mark = F.xxhash64(F.lit("decontamination"), F.col(text).cast("string"))
        for k, (seeds, _, _, only) in enumerate(self.blocks(benchmark, item, item_text)):
            held = sc.broadcast(seeds)
            if only:
                return docs.mapInArrow(_cleaner(text, held, self.min_match, self.coverage), docs.schema)
            stash = stash or Stash(docs.sparkSession, "decontamination")
            marks = docs.select(mark.alias("mark"), F.col(text).cast("string").alias("text"))
            part = stash.put(f"block{k}", marks.mapInArrow(_finder(held, self.min_match, self.coverage), "mark long").distinct())
            held.destroy()
            found = part if found is None else found.union(part)
        return without(docs, mark, stash.put("found", found.distinct()), stash)


def texts_of_table(table: pa.Table) -> list[bytes]:
    return [t for batch in table.combine_chunks().to_batches() for t in texts_of(batch, "text")]


def _matcher(held, size: int, coverage: float, names: list[str]):
    def run(batches):
        seeds, ids, times = held.value
        often = times.to_pylist()
        for batch in pieces(batches):
            rows = [(k, f) for k, found in enumerate(_search(seeds, texts_of(batch, "text"), size, coverage)) for f in found for _ in range(often[f.item])]
            lengths = [len(seeds["items"][f.item]) for _, f in rows]
            columns = [
                batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())),
                ids.take(pa.array([f.item for _, f in rows], pa.int64())),
                pa.array(lengths, pa.int64()),
                pa.array([f.covered for _, f in rows], pa.int64()),
                pa.array([f.covered / n for (_, f), n in zip(rows, lengths, strict=True)], pa.float64()),
                pa.array([f.n_tiles for _, f in rows], pa.int64()),
                pa.array([f.longest for _, f in rows], pa.int64()),
                pa.array([True] * len(rows), pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _cleaner(text: str, held, size: int, coverage: float):
    def run(batches):
        for batch in pieces(batches):
            keep = [not found for found in _search(held.value, texts_of(batch, text), size, coverage)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _finder(held, size: int, coverage: float):
    def run(batches):
        for batch in pieces(batches):
            hit = [bool(found) for found in _search(held.value, texts_of(batch, "text"), size, coverage)]
            yield batch.select(["mark"]).filter(pa.array(hit, pa.bool_()))

    return run
