"""The registered queries, each next to the SQL that gives the same rows."""

from lexiloom.catalog import models, reading, splitting, text, vectors  # noqa: F401
from lexiloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
