"""Training-data operators: cleaning, deduplication, search, scoring and packing of text corpora.

Nothing outside this subpackage imports it.
"""
