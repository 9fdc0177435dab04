"""Operators on event streams."""

from .basic import expand, filter_events, map_values, reduce_stream, stream_graph
from .joins import join_elements, join_windows, join_zip
from .merging import merge, merge_exact
from .stateful import changes, filter_acc, map_cache, record_highs, sample, scan, scan_fold, sequential, sessions, steps
from .windows import Chop, ChopTime, Complete, Custom, Sliding, SlidingTime, window, window_aggregate, window_rows

__all__ = [
    "Chop", "ChopTime", "Complete", "Custom", "Sliding", "SlidingTime", "changes", "expand", "filter_acc", "filter_events", "join_elements", "join_windows",
    "join_zip", "map_cache", "map_values", "merge", "merge_exact", "record_highs", "reduce_stream", "sample", "scan", "scan_fold", "sequential", "sessions", "steps",
    "stream_graph", "window", "window_aggregate", "window_rows",
]
