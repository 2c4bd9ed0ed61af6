"""The graph table pair every operator works on."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import vec


@dataclass(frozen=True)
class Graph:
    """``nodes(id, ...)`` and ``edges(src, dst, w, ...)``.

    ``nodes`` is authoritative: an id without edges still counts, and results that
    reduce over edges fill such nodes with zero. Many graphs live in one table pair
    with a ``graph_id`` column on nodes and globally unique ids. ``x`` is the feature
    array, ``dim`` its width.
    """
    nodes: DataFrame
    edges: DataFrame
    dim: int = 0

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, dim: int | None = None) -> "Graph":
        if "w" not in edges.columns:
            edges = edges.withColumn("w", F.lit(1.0))
        if dim is None:
            dim = vec.width(nodes, "x") if "x" in nodes.columns else 0
        return Graph(nodes, edges, dim)

    @staticmethod
    def from_edges(edges: DataFrame) -> "Graph":
        """Nodes 0..max(id), as when no node count is given."""
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return Graph.of(edges.sparkSession.range(0 if top is None else top + 1), edges, 0)

    def with_nodes(self, nodes: DataFrame, dim: int | None = None) -> "Graph":
        return replace(self, nodes=nodes, dim=self.dim if dim is None else dim)

    def with_edges(self, edges: DataFrame) -> "Graph":
        return replace(self, edges=edges)

    def features(self, *ids: str) -> DataFrame:
        return self.nodes.select(*(ids or ("id",)), "x")
