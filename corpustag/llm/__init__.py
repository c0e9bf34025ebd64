"""Operators for training-data pipelines: fingerprints, joins, packing, cleaning, archives, sharding and mixing."""
