"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; ``queries`` lists what it
registers. Each module holds one operator with a general interface, and the
thin ``opN_*`` queries in ``queries.py`` bind them to the given tables.
"""
