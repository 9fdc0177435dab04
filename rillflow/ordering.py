"""Positions and running folds over a total order, without sorting a stream in one task.

Rows are cut into buckets that follow the order (spans of ``seq``, or of any number that never falls along the order). A
window within a bucket gives local results; a table with one row for each bucket carries counts or totals over from the
buckets before. Only that table, smaller by the size of a bucket, meets in one window. A stream with keys is
partitioned by key as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_BUCKET, _LOCAL, _CARRY = "__bucket", "__local", "__carry"


def bucketed(df: DataFrame, along: Column, span: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.floor(along / F.lit(span)).cast("long"))


def _same(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Left join on key and bucket; null keys are equal."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col(_BUCKET).alias("__b"), _CARRY)
    on = left[_BUCKET] == renamed["__b"]
    for k in key:
        on = on & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, on, "left").drop("__b", *[f"__k_{k}" for k in key])


def numbered(df: DataFrame, name: str, order: list[Column | str], along: Column, span: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds the position (bigint, from 0) of each row in its key's order."""
    rows = bucketed(df, along, span)
    counts = rows.groupBy(*key, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.withColumn(_CARRY, F.coalesce(F.sum("__n").over(before), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*key, _BUCKET).orderBy(*order)).cast("long") - 1
    out = _same(rows.withColumn(_LOCAL, local), carry, key)
    return out.withColumn(name, F.col(_LOCAL) + F.col(_CARRY)).drop(_BUCKET, _LOCAL, _CARRY)


def running(
    df: DataFrame,
    name: str,
    fold: Callable[[Column], Column],
    value: Column,
    join: Callable[[Column, Column], Column],
    order: list[Column | str],
    along: Column,
    span: int,
    key: tuple[str, ...] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Adds a running fold of ``value``: an aggregate function, and how two of its results combine (null: nothing yet).

    ``inclusive`` counts the row itself; otherwise the fold covers the rows before it.
    """
    rows = bucketed(df, along, span).withColumn("__v", value)
    totals = rows.groupBy(*key, _BUCKET).agg(fold(F.col("__v")).alias("__t"))
    before = Window.partitionBy(*key).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn(_CARRY, fold(F.col("__t")).over(before))
    own = Window.partitionBy(*key, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = _same(rows.withColumn(_LOCAL, fold(F.col("__v")).over(own)), carry, key)
    return out.withColumn(name, _either(F.col(_CARRY), F.col(_LOCAL), join)).drop(_BUCKET, _LOCAL, _CARRY, "__v")


def _either(a: Column, b: Column, join: Callable[[Column, Column], Column]) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))


def previous(df: DataFrame, name: str, value: Column, order: list[Column], along: Column, span: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds a struct (v) of ``value`` in the row before, null in the first row; v itself may be null."""
    rows = bucketed(df, along, span).withColumn("__v", F.struct(value.alias("v")))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    lasts = rows.groupBy(*key, _BUCKET).agg(F.max_by("__v", at).alias("__t"))
    carry = lasts.withColumn(_CARRY, F.lag("__t").over(Window.partitionBy(*key).orderBy(_BUCKET)))
    own: WindowSpec = Window.partitionBy(*key, _BUCKET).orderBy(*order)
    out = _same(rows.withColumn(_LOCAL, F.lag("__v").over(own)), carry, key)
    return out.withColumn(name, F.coalesce(_LOCAL, _CARRY)).drop(_BUCKET, _LOCAL, _CARRY, "__v")


def ahead(df: DataFrame, position: str, n: int, block: int) -> DataFrame:
    """Rows with a column ``__block``, such that a row and the ``n - 1`` after it are in the row's own block.

    Blocks are spans of positions; the first rows of a block stand in the one before as well, marked ``__halo``.
    """
    block = max(block, n)
    own = F.floor(F.col(position) / F.lit(block)).cast("long")
    near = F.when((F.col(position) % block < n - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = df.withColumn("__own", own).withColumn("__block", F.explode(near))
    return rows.withColumn("__halo", F.col("__own") != F.col("__block")).drop("__own")
