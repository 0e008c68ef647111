"""Connected components whose rounds are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that edges (u, v) reach. Nodes without an edge are not in it."""
    return graph.components(edges, materialise)
