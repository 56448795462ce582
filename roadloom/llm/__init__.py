"""Training-data operators: deduplication, extraction, formatting, counting, filtering and packing of text corpora.

Nothing outside this subpackage imports it.
"""
