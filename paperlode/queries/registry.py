"""All registered queries."""

from paperlode.queries import files, functions, jobs, rows  # noqa: F401
from paperlode.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
