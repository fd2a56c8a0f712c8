"""Training-data operators: deduplication, packing, tokenizing, quality rules, fixity and placement.

Nothing else in the library imports this subpackage.
"""
