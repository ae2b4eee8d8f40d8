"""Operators for training text: fingerprints, quality, duplicates, URLs, mixing, tokens, secrets."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
