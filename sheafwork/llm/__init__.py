"""Training-data operators: deduplication, decontamination, extraction, scoring, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
