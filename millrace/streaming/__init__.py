"""Structured Streaming operators: windowed distinct counts, membership filters, reservoir samples."""
