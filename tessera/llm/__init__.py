"""Training-data operators: scoring, filtering, deduplication, sharding and packing of text.

Nothing else in the library imports this package. Each operator is a module with
its own general interface; ``queries.py`` holds the thin registered queries.
"""
