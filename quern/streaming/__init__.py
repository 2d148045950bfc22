"""Structured Streaming over the events table's schema."""

from quern.streaming.windows import event_windows, read_events

__all__ = ["event_windows", "read_events"]
