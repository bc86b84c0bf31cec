"""Structured Streaming: keyed tracking and windowed summaries."""
