"""Training-data operators: mixing, search, dedup, extraction, packing.

Nothing outside this subpackage imports it.
"""
