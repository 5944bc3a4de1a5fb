"""Operators for building training data: filters, near duplicates, packing, sharding and language models."""
