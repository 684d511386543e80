"""Operators of a training-data pipeline: deduplication, search, sharding, packing, extraction, mixing, quality, scoring, token output.

Nothing outside this subpackage imports it.
"""
