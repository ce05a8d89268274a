"""Connected components of a graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.identity import connected_components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component."""
    return connected_components(edges, a, b).select("node", F.col("component").alias("root"))
