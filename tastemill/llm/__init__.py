"""Operators of a training-data pipeline: dedup, quality, language, extraction, packing, search."""
