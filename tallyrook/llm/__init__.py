"""Training-data operators: scoring, cleaning, deduplication, formatting, encoding and sharding of text.

Nothing outside this subpackage imports it.
"""
