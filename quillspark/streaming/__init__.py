"""Structured Streaming variants of the monthly counts (an extension; batch queries don't need it)."""
