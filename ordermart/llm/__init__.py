"""Operators for training-data pipelines: scans, near-duplicates, packing, classifiers, search."""
