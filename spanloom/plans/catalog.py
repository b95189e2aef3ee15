"""All registered queries."""

from spanloom.plans import q_corpus, q_insights, q_parse  # noqa: F401
from spanloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
