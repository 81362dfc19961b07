"""Structured Streaming jobs over the telemetry log."""
