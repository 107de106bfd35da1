"""Structured Streaming: buffered writes, usage counters, retention windows, deadlines."""
