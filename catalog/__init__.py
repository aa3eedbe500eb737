"""Registered queries: each operator over the given tables, with its SQL twin."""

from catalog import curation, features, metrics, pairs, scoring, tokens, training  # noqa: F401
from catalog.base import REGISTRY

__all__ = ["REGISTRY"]
