"""Readers and writers of knowledge-graph files."""
