"""Operators for training data: tokens, deduplication, quality, formatting, decontamination."""
