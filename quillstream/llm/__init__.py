"""Operators of a training-data pipeline: deduplication, sharding, media, filtering, mixing, tokenising, scoring."""
