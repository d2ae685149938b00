"""Structured Streaming jobs: incremental index append, running metrics, per-document scoring."""
