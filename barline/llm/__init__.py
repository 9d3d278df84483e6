"""Training-data operators: sharding, mixing, filtering, scoring and deduplication of text.

Nothing outside this subpackage imports it.
"""
