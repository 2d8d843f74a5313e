"""Operators for preparing training data: deduplication, quality, decontamination, packing."""
