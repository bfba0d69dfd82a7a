"""Training-data operators: counting, formatting, filtering, deduplicating and packing text.

Nothing else in the library imports this subpackage.
"""
