"""Training-data operators: deduplication, filtering, packing and tokenising of document tables.

Nothing else in the library imports this subpackage.
"""
