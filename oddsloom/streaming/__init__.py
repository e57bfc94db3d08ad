"""Structured Streaming jobs on price snapshots."""
