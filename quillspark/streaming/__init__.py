"""Incremental refresh as a file stream."""
