"""Scans of containers and serialized files."""
