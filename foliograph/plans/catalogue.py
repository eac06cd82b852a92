"""Queries and oracles, joined from the groups beside this module."""

from __future__ import annotations

from . import output, structure, text_queries, whole

QUERIES = text_queries.QUERIES | structure.QUERIES | output.QUERIES | whole.QUERIES
ORACLES = text_queries.ORACLES | structure.ORACLES | output.ORACLES | whole.ORACLES
