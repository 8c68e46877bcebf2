"""Operators for preparing text corpora: copies, leaks, personal data, tokens, scores."""
