"""Graph, sparse-matrix and event analytics written as Spark DataFrame jobs."""
from .graph import Graph  # noqa: F401
