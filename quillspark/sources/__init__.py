"""Scans of manifests, files and tables."""
