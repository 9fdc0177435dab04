"""Bounded samples of labelled documents for fitting classifiers: bounded in rows and in bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import pieces, small_batches, texts_of
from .words import ALNUM_FOLDED, _groups, windows

_SIEVE = 1 << 30
#: Bytes of text that a sample has at most.
SAMPLE_BYTES = 64 << 20
#: Copies share minima of their 5-word runs under these mixes.
_MIXES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def sample_of(labels: DataFrame, id_: str, columns: list[str], rows: int) -> pa.Table:
    """At most about ``rows`` labelled ids, chosen by a hash of the id; an id with several labels keeps its largest ones.

    Collected to the driver: ``rows`` bounds it (the expected number; the spread is its square root).
    """
    clean = labels.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), *[F.col(c).cast("int").alias(c) for c in columns]).dropna()
    clean = clean.groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    n = labels.where(F.col(id_).isNotNull()).select(id_).dropna().agg(F.approx_count_distinct(id_)).first()[0]
    part = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(_SIEVE))
    chosen = clean.where(part < int(_SIEVE * min(1.0, rows / max(n, 1)))) if n > rows else clean
    return chosen.orderBy("id").toArrow()


def _marks(texts: list[bytes]) -> list[list[int] | None]:
    out = []
    for h, cut in _groups(texts, ALNUM_FOLDED):
        for i in range(len(cut) - 1):
            runs = windows(h[cut[i] : cut[i + 1]], 5)
            out.append([int(m) for m in ((runs[:, None] ^ (runs[:, None] >> np.uint64(31))) * _MIXES).min(0).view(np.int64)] if len(runs) else None)
    return out


def _rows(features: Callable[[list[bytes]], list[bytes]]):
    def run(batches):
        for batch in pieces(batches):
            texts = texts_of(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_marks(texts), pa.list_(pa.int64())), pa.array(features(texts), pa.binary())], ["place", "marks", "features"])

    return run


def labelled_features(docs: DataFrame, chosen: pa.Table, id_: str, text: str, features: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``chosen``, copy marks, bytes of features of each, all features one after another) of the chosen documents that exist and have words.

    Of an id's different texts, the one with the least hash counts, and repeated rows count once. If the texts have more than
    ``SAMPLE_BYTES`` bytes, only those with the least hashes are taken; the first is taken in any case.
    """
    spark = docs.sparkSession
    small_batches(spark)
    none = np.empty(0, np.int64), np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    if not chosen.num_rows:
        return none
    ids = spark.createDataFrame(chosen.select(["id"]).append_column("place", pa.array(range(chosen.num_rows), pa.int64())))
    own = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "id").drop("id")
    own = own.withColumn("hash", F.xxhash64("text"))
    lengths = own.groupBy("place").agg(F.min(F.struct("hash", F.octet_length("text").alias("bytes"))).alias("least")).select("place", "least.*").collect()
    if not lengths:
        return none
    lengths.sort(key=lambda r: (r["hash"], r["place"]))
    total = np.cumsum([r["bytes"] for r in lengths])
    taken = [(r["place"], r["hash"]) for r, t in zip(lengths, total, strict=True) if t <= SAMPLE_BYTES] or [(lengths[0]["place"], lengths[0]["hash"])]
    rows = own.join(F.broadcast(spark.createDataFrame(taken, "place long, hash long")), ["place", "hash"]).select("place", "text")
    found = rows.mapInArrow(_rows(features), "place long, marks array<long>, features binary").where("marks is not null")
    table = found.groupBy("place").agg(F.first("marks").alias("marks"), F.first("features").alias("features")).toArrow().sort_by("place")
    if not table.num_rows:
        return none
    marks = np.concatenate([c.flatten().to_numpy() for c in table.column("marks").chunks]).reshape(-1, 3)
    packed = table.column("features").combine_chunks()  # read where it is: no copy is made
    packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    held = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return table.column("place").to_numpy(), marks, np.diff(ends).astype(np.int64), held
