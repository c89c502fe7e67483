"""Operators for large text corpora and vector tables: packing, sharding, mixing, de-duplication, scoring and search."""
