"""Operators on document tables: one DataFrame in, one out, ``doc_id`` in every key."""
