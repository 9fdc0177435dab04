"""Shared storage and Arrow batches, as the operators of this package use them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes (one longer row aside) that a function takes at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20
#: Spark's setting of how many bytes of rows it sends to Python at a time.
_SENT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that deletes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session sets a size. Returned frames run later, so the setting stays."""
    if _SENT not in spark.conf.getAll:
        spark.conf.set(_SENT, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where one machine does it all, may a session name none; then it is a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rillflow-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession):
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Stash:
    """Tables written to the shared folder to cut lineage; they outlive lost executors.

    The shuffle files behind a table go as soon as it is written. ``drop`` deletes tables that no later step reads;
    what a returned DataFrame still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        target, system = self._file_system(self.root)
        system.mkdirs(target)
        system.deleteOnExit(target)

    def _file_system(self, path: str):
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(sc._jsc.hadoopConfiguration())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with _cleaning(self.spark):
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                target, system = self._file_system(path)
                system.delete(target, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it (upper and lower case alike)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes, and at least a row."""
    for batch in batches:
        n = batch.num_rows
        rows = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
        at = 0
        while at < n:
            own = rows
            while own > 1 and batch.slice(at, own).nbytes > 2 * BATCH_BYTES:
                own = (own + 1) // 2
            yield batch.slice(at, own)
            at += own


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    col = col.fill_null("")
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
