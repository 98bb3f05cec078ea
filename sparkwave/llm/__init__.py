"""Operators for text corpora: deduplication, tokens, quality, toxicity, packing."""
