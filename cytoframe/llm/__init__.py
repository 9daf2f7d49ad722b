"""Operators of a training-data pipeline: quality, packing, search, sharding, mixing and models of text."""
