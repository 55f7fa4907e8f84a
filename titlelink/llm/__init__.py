"""Operators of a training-data pipeline: decontamination, filters, deduplication, sharding, packing, classifiers."""
