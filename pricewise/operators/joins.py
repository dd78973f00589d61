"""Dimension lookups.

No broadcast hints: Spark broadcasts a side only if its size, estimated or measured at
run time by AQE, is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles
(and splits skewed keys).  A hint would force any table that is small today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Fact joined to a dimension."""
    return fact.join(dim, on, how)
