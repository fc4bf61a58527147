"""Structured Streaming forms of the label-log operators."""
