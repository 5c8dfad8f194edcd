"""Reports as a stream: an addition to the batch engine."""

from .reports import graded_stream, watch_reports

__all__ = ["graded_stream", "watch_reports"]
