"""The windows over time for unbounded input."""

from tessera.streaming.windows import gap_sessions, threshold_sessions, tumbling

__all__ = ["gap_sessions", "threshold_sessions", "tumbling"]
