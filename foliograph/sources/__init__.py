"""Readers, synthesised documents and sinks."""
