"""Operators for preparing training data: duplicates, quality, language models, mixing, tokens."""
