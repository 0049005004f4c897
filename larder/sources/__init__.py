"""Readers, cleaning and table storage."""
