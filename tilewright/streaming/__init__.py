"""Incremental runs over new slides."""
