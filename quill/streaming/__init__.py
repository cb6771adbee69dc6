"""Structured Streaming: event-time windows, failure streaks, host blocking, paces and intake states."""
