"""Taking marked rows out of a table without shuffling the table.

A mark is a 64-bit name of a row. A bit filter of the marks that go decides most rows; those of the marks that stay but pass
the first filter by chance are in a second one, so only rows that pass both are looked up by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .runtime import Stash, fresh


def _sorter(gone, doubtful):
    """0 for a mark that surely stays, 1 if it must be looked up, 2 if it surely goes."""

    @F.arrow_udf("int")
    def sort(marks: pa.Array) -> pa.Array:
        values = marks.to_numpy(zero_copy_only=False).astype(np.int64)
        out, other = gone.value.passes(values), doubtful.value.passes(values)
        return pa.array(np.where(out, np.where(other, 1, 2), 0).astype(np.int32))

    return sort


def _passing(bits):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bits.value.passes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    return run


def filter_of(marks: DataFrame):
    """The broadcast filter of a table of marks."""
    return marks.sparkSession.sparkContext.broadcast(filters.build(marks, filters.longs, marks.count()))


def passing(marks: DataFrame, bits) -> DataFrame:
    """The marks that pass a filter."""
    return marks.mapInArrow(_passing(bits), "mark long")


def dealt(docs: DataFrame, mark: Column, gone, stays: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows that surely stay; rows to look up, with their mark; the name of that column).

    ``gone``: the filter of what goes; ``stays``: all marks that stay and pass it.
    """
    name, sort = (fresh(f"__{c}", docs.columns) for c in ("mark", "sort"))
    sorted_ = docs.withColumn(name, mark).withColumn(sort, _sorter(gone, filter_of(stays))(F.col(name)))
    return sorted_.where(F.col(sort) == 0).select(*docs.columns), sorted_.where(F.col(sort) == 1).drop(sort), name


def without(docs: DataFrame, mark: Column, marks: DataFrame, stash: Stash) -> DataFrame:
    """The rows whose mark is not in a table of distinct marks (column ``mark``)."""
    bits = filter_of(marks)
    stays = stash.put("stays", passing(docs.select(mark.alias("mark")), bits).distinct().join(marks, "mark", "left_anti"))
    sure, doubtful, name = dealt(docs, mark, bits, stays)
    return sure.union(doubtful.join(stays.withColumnRenamed("mark", name), name, "left_semi").select(*docs.columns))
