"""Incremental versions of the append-only record flows."""
