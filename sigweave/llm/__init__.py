"""Operators for large text corpora: packing, similarity joins, scoring, deduplication."""
