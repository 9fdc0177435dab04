"""Functions that programs over event streams share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The middle element of a sorted list; of an even number, the upper one. Null for an empty list."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def hashtags(text: Column, prefix: str = "#") -> Column:
    """The words of a text that begin with ``#`` (or another prefix)."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.startswith(prefix))


def words(text: Column) -> Column:
    """The words of a text, by white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def int_sqrt(x: Column) -> Column:
    """The root of an integer, rounded; half-way cases do not occur."""
    return F.round(F.sqrt(x)).cast("long")


def grid_cell(degrees: Column, origin: float, step: float) -> Column:
    """Number of a grid cell from 1, in single precision as positions are given."""
    one = lambda x: F.lit(x).cast("float")
    return (F.floor((degrees.cast("float") - one(origin)) / one(step)) + 1).cast("long")


def in_grid(cell: Column, cells: int) -> Column:
    return cell.between(1, cells)


def top_k(counts: DataFrame, by: list[str], k: int, count: str, *ties: str) -> DataFrame:
    """The ``k`` largest counts of each group, ties by the given columns; adds ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(count), *ties)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def profit(fare: Column, tip: Column) -> Column:
    """A trip's earnings."""
    return fare + tip


def fib_cost(n: int) -> int:
    """A deliberately expensive function: calls of the naive Fibonacci recursion."""
    return 1 if n < 2 else fib_cost(n - 1) + fib_cost(n - 2) + 1
