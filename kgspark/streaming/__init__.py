"""Incremental forms of batch operators."""
