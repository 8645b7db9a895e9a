"""Operators of a training-data pipeline: mixing, de-duplication, scans, filters, search and packing."""
