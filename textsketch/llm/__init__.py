"""Training-data operators: packing, scoring, deduplication, extraction, filtering.

Nothing else in the library imports this subpackage.
"""
