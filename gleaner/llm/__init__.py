"""Operators of a training-data pipeline: quality, language, duplicates, mixing, packing, sharding, search, archives."""
