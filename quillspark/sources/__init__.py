"""Readers with explicit schemas and guarded writers."""
