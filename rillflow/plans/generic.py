"""Functions that work on plain values and on Columns alike, so that rewrites may fuse them on either side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _columns(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def both(a, b):
    """a and b."""
    return a & b if _columns(a, b) else bool(a) and bool(b)


def pick(condition, yes, no):
    """yes if the condition holds, else no."""
    if _columns(condition, yes, no):
        return F.when(condition, yes).otherwise(no)
    return yes if condition else no


def map_list(f, values):
    return F.transform(values, f) if isinstance(values, Column) else [f(v) for v in values]


def filter_list(p, values):
    """The elements that satisfy p; of a Column, null counts as no."""
    return F.filter(values, lambda v: F.coalesce(p(v), F.lit(False))) if isinstance(values, Column) else [v for v in values if p(v)]


def concat_lists(values):
    return F.flatten(values) if isinstance(values, Column) else [v for part in values for v in part]


def is_filled(values):
    return F.size(values) > 0 if isinstance(values, Column) else len(values) > 0


def length(values):
    return F.size(values).cast("long") if isinstance(values, Column) else len(values)


def filter_acc_list(f, p, acc, values: list):
    """Stateful filter of a plain list: (kept values, last accumulator)."""
    kept = []
    for v in values:
        if p(v, acc):
            kept.append(v)
        acc = f(acc, v)
    return kept, acc
