"""Operators that prepare text for training: deduplication, filtering, formatting, tokenizing and packing."""
