"""Structured Streaming forms: order states, fills delivered more than once, refreshed records, and bars."""
