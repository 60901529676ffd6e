"""Operators of a training-data pipeline: cleaning, deduplication, search, tokens and packing.

Nothing else in the package imports this folder.
"""
