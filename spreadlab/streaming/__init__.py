"""Structured Streaming: bars under a watermark, stateful signals."""
