"""Streams of queries against one static dictionary."""

from .queries import common_prefix_stream, lookup_stream, predictive_count_stream

__all__ = ["common_prefix_stream", "lookup_stream", "predictive_count_stream"]
