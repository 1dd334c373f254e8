"""Training-data operators: deduplication, scoring, packing and formatting of text corpora.

Nothing else in the library imports this subpackage.
"""
