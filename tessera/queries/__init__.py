"""Queries over the driver's tables; importing the package fills the registry."""

from tessera.queries import relations, sources, text  # noqa: F401
from tessera.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
