"""Registered queries of the engine and their SQL."""

from .plans.oracle import ORACLE_SQL
from .plans.survey import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
