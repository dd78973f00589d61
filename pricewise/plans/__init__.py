"""Registered queries.  Importing this package fills ``QUERIES`` and ``ORACLE``."""

from pricewise.plans import q_core, q_kpi, q_model, q_series, q_stream  # noqa: F401
from pricewise.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
