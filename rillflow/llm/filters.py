"""Bit filters (Bloom filters) of 64-bit hashes, built on the executors in slices and sized by count.

A filter spares work: what does not pass is surely not in it. Whoever uses one must be right whatever else passes.
Hashes go by their upper 40 bits. Each of the slices that the uppermost bits name has its own stretch of the filter, so a
slice is built in one task, from packed rows, and no task holds more than one slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter for each value, and at most (64 MB; fuller ones let more pass).
BITS_EACH, MOST_BITS = 16, 29
#: Values that one slice should hold, and those that a task packs at a time.
SLICE, PACKED = 1 << 21, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass
class BitFilter:
    words: np.ndarray
    slice_bits: int

    @property
    def stretch(self) -> int:
        """Bits of one slice."""
        return (len(self.words) << 6) >> self.slice_bits

    def passes(self, values: np.ndarray) -> np.ndarray:
        v = values.view(np.uint64) >> np.uint64(24)
        base = (v >> np.uint64(40 - self.slice_bits)) * np.uint64(self.stretch)
        ok = np.ones(len(v), bool)
        for at in _places(v & _LOW, self.stretch):
            at = at + base
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _places(low: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (low + np.uint64(1)) * _MIX
    mask = np.uint64(stretch - 1)
    return (mixed >> np.uint64(36)) & mask, (mixed >> np.uint64(8)) & mask


def _packer(values_of, slice_bits: int, twice: bool):
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(held) >> np.uint64(24)
        v.sort()
        again = np.concatenate(([False], v[1:] == v[:-1]))
        keep = ~again
        if twice:  # two of each value are as good as more
            keep |= again & ~np.concatenate(([False], again[:-1]))
        v = v[keep]
        own = (v >> np.uint64(40 - slice_bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        low = (v & _LOW).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["slice", "raw"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(values_of(batch))
            n += len(held[-1])
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _builder(stretch: int, twice: bool):
    def built(parts: list[bytes]) -> bytes:
        low = np.frombuffer(b"".join(parts), np.uint32)
        if twice:
            low = np.sort(low)
            low = low[1:][low[1:] == low[:-1]]
        bits = np.zeros(stretch, bool)
        for at in _places(low.astype(np.uint64), stretch):
            bits[at.astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def run(batches):
        now, parts = None, []
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now and parts:
                    out.append((now, built(parts)))
                    parts = []
                now = k
                parts.append(raw.as_buffer().to_pybytes())
            if out:
                yield _rows(out)
        if parts:
            yield _rows([(now, built(parts))])

    return run


def _rows(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["slice", "raw"])


def build(df: DataFrame, values_of, count: int, bits_each: float = BITS_EACH, twice: bool = False) -> BitFilter:
    """The filter of the hashes that ``values_of`` takes from the Arrow batches of ``df``; with ``twice``, of those found two times.

    ``count``: about how many hashes there are, which sets the size. Collected to the driver: ``2**MOST_BITS`` bits at most.
    """
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1.0, count * bits_each))))))
    slice_bits = min(bits - 6, max(8, int(np.ceil(np.log2(max(1.0, count / SLICE))))))
    stretch = 1 << (bits - slice_bits)
    dealt = df.mapInArrow(_packer(values_of, slice_bits, twice), "slice int, raw binary").repartition("slice").sortWithinPartitions("slice")
    table = dealt.mapInArrow(_builder(stretch, twice), "slice int, raw binary").toArrow()
    words = np.zeros((1 << slice_bits, stretch // 64), np.uint64)
    for k, raw in zip(table.column("slice").to_pylist(), table.column("raw"), strict=True):
        words[k] = np.frombuffer(raw.as_buffer(), np.uint64)
    return BitFilter(words.ravel(), slice_bits)


def longs(batch: pa.RecordBatch) -> np.ndarray:
    """``values_of`` for a table of one column of hashes."""
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
