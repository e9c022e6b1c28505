"""Operators of a training-data pipeline: mixing, deduplication, scans, extraction, fingerprints."""
