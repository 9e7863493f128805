"""Operators for large text corpora: deduplication, mixing, token files, search, labelling."""
