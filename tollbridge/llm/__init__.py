"""Operators on document texts: cleaning, deduplication, tokens."""
