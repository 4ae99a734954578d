"""Operators for building training corpora: quality, extraction, scoring, dedup, search, tokens."""
