"""Structured Streaming: running confusion counters over a file stream."""
