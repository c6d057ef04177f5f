"""Operators of a training-data pipeline: joins of near copies, packing, labelling, dedup, mixing, sharding, extraction."""
