"""Operators for preparing training text, vectors and media at scale."""
