"""Operators for preparing text corpora: language, tokens, toxicity, duplicates, leaks, archives, neighbours."""
