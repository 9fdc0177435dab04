"""Live streams: Structured Streaming forms of the operators, and running them."""

from .live import (
    live_chop,
    live_chop_time,
    live_expand,
    live_filter_acc,
    live_join_elements,
    live_join_windows,
    live_merge,
    live_scan,
    live_sessions,
    live_sliding,
    live_sliding_time,
    live_zip,
)
from .running import ProgressMetrics, node, start

__all__ = ["ProgressMetrics", "live_chop", "live_chop_time", "live_expand", "live_filter_acc", "live_join_elements", "live_join_windows", "live_merge", "live_scan", "live_sessions", "live_sliding", "live_sliding_time", "live_zip", "node", "start"]
