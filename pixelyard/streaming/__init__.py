"""Structured Streaming forms: rate limits, windowed counts, asset and load streams."""
