"""Operators of a training-data pipeline: deduplication, packing, counting, search, scoring, sharding and mixing."""
