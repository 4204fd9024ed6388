"""All registered queries and their SQL."""

from gridloom.catalog.registry import QUERIES, SQL
from gridloom.catalog import kernels, pipeline  # noqa: F401  (registers)

__all__ = ["QUERIES", "SQL"]
