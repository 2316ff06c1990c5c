"""Differentially private releases over event-time windows of a stream."""

from .budgets import stream_budgeted_counts
from .windows import release_sessions, release_windows, session_counts, stream_dp_counts, window_counts

__all__ = ["release_sessions", "release_windows", "session_counts", "stream_budgeted_counts", "stream_dp_counts", "window_counts"]
