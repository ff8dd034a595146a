"""Incremental processing of files that arrive."""
