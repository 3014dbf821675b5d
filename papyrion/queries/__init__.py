"""Registered queries over the test tables, with their DuckDB equivalents."""

from papyrion.queries import corpus, graph, keywords, phrases, raters, records, stored, validation  # noqa: F401
from papyrion.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
