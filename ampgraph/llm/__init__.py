"""Training-data operators: near-dedup, search, sharding, scoring, packing and mixing.

Nothing else in the library imports this subpackage.
"""
