"""Training-data operators: dedup, decontamination, mixing, sharding, filtering, scoring, search.

Nothing else in the library imports this subpackage.
"""
