"""Structured Streaming forms of the window, group and cache operators."""
