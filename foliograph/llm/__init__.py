"""Operators of a training-data pipeline: one module each, queries in ``queries.py``.

Nothing outside this subpackage imports it.
"""
