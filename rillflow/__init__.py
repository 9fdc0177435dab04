"""Functional analytics over ordered event streams, as Spark DataFrames and Structured Streaming queries."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from .events import EventStream, from_values, retime

# Functions sent to executors carry their code, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["EventStream", "from_values", "retime"]
