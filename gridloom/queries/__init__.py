"""The queries of the engine and the SQL that each is checked against."""

from . import footprints, rasters, vectors  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
