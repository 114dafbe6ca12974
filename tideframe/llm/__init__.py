"""Training-data operators: near-duplicate search, packing, sharding, scoring, filtering and extraction.

Nothing outside this subpackage imports it.
"""
