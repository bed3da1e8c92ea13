"""Readers and writers; every one has an explicit schema."""
