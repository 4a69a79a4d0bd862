"""Operators for training-data corpora: readers, filters, deduplication, search, mixing and tokenizing."""
