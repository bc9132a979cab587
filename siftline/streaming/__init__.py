"""Keyed state over time: batch folds and Structured Streaming."""
