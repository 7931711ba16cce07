"""Operators for large text corpora: deduplication, cleaning, privacy, extraction and tokenisation."""
