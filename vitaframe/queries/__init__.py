"""Registered queries: every operator applied to the given tables."""

from vitaframe.queries import catalog, metrics, sections, skills, text, validation, vectors  # noqa: F401
from vitaframe.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
