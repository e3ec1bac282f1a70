"""Operators for preparing training data: decontamination, deduplication, privacy, quality and mixing."""
