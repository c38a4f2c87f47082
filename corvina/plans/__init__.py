"""Named queries over the input tables and their SQL."""

from corvina.plans.registry import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
