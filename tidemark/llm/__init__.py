"""Operators for training-data pipelines: filters, detectors, deduplication, archives, tokens."""
