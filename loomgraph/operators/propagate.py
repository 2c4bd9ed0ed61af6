"""Gather, message, aggregate: the one builder behind every message-passing layer."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..graph import Graph


class Side:
    """Names the columns a message asks of one endpoint; untouched sides are not joined."""

    def __init__(self, tag: str, dim: int):
        self.tag, self.dim, self.asked = tag, dim, []

    def __getitem__(self, name: str) -> Column:
        if name not in self.asked:
            self.asked.append(name)
        return F.col(f"_{self.tag}_{name}")

    def vec(self, name: str = "x", dim: int | None = None) -> list[Column]:
        return vec.parts(self[name], self.dim if dim is None else dim)


def gather(g: Graph, message: Callable[[Side, Side], Sequence[Column]],
           flow: str = "source_to_target") -> tuple[DataFrame, str]:
    """Per-edge messages m0..mk beside the edge columns, and the target column's name."""
    source, target = ("src", "dst") if flow == "source_to_target" else ("dst", "src")
    j, i = Side("j", g.dim), Side("i", g.dim)
    parts = message(j, i)
    joined = g.edges
    for side, key in ((j, source), (i, target)):
        if side.asked:
            joined = joined.join(g.nodes.select(
                F.col("id").alias(key),
                *[F.col(c).alias(f"_{side.tag}_{c}") for c in side.asked]), key)
    return joined.select(*g.edges.columns, *[p.alias(f"m{k}") for k, p in enumerate(parts)]), target


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "add": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "mul": F.product,
}


def propagate(g: Graph, message: Callable[[Side, Side], Sequence[Column]] | None = None,
              aggr: str = "add", flow: str = "source_to_target", out: str = "out") -> DataFrame:
    """Nodes plus ``out`` ARRAY<DOUBLE>, zero where a node receives nothing.

    The default message is ``x_j``. Aggregates are algebraic, so Spark combines them
    map-side and a hub's messages do not pile up in one task.
    """
    width: list[int] = []

    def counted(j: Side, i: Side) -> list[Column]:
        parts = list(message(j, i)) if message else j.vec()
        width.append(len(parts))
        return parts

    per_edge, target = gather(g, counted, flow)
    agg = AGGREGATES[aggr]
    summed = per_edge.groupBy(F.col(target).alias("id")).agg(
        *[agg(f"m{k}").alias(f"m{k}") for k in range(width[0])])
    zeroed = vec.pack([F.coalesce(f"m{k}", F.lit(0.0)) for k in range(width[0])])
    return g.nodes.join(summed, "id", "left").select("*", zeroed.alias(out)).drop(
        *[f"m{k}" for k in range(width[0])])


def weighted(j: Side, i: Side) -> list[Column]:
    """w * x_j"""
    return [F.col("w") * c for c in j.vec()]


def group_softmax(df: DataFrame, score: Sequence[str], group: str) -> DataFrame:
    """Replace ``score`` columns by their softmax within ``group``.

    The shift is the global maximum and 1e-16 joins the denominator, as published.
    Sums come from an aggregate and a join rather than a window, so a hot group splits.
    """
    top = df.agg(*[F.max(s).alias(f"_top_{s}") for s in score])  # one row
    shifted = df.crossJoin(F.broadcast(top)).withColumns(
        {s: F.exp(F.col(s) - F.col(f"_top_{s}")) for s in score}).drop(
        *[f"_top_{s}" for s in score])
    totals = shifted.groupBy(group).agg(*[F.sum(s).alias(f"_sum_{s}") for s in score])
    return shifted.join(totals, group).withColumns(
        {s: F.col(s) / (F.col(f"_sum_{s}") + 1e-16) for s in score}).select(*df.columns)


def attend(g: Graph, score: Callable[[Side, Side], Sequence[Column]],
           value: Callable[[Side, Side], Sequence[Sequence[Column]]],
           flow: str = "source_to_target", out: str = "out") -> DataFrame:
    """Softmax-weighted sum per target: head h weighs ``value[h]`` by softmax(score[h])."""
    shape: list[tuple[int, int]] = []

    def both(j: Side, i: Side) -> list[Column]:
        s, v = list(score(j, i)), [list(h) for h in value(j, i)]
        shape.append((len(s), len(v[0])))
        return s + [c for h in v for c in h]

    per_edge, target = gather(g, both, flow)
    heads, chans = shape[0]
    soft = group_softmax(per_edge, [f"m{h}" for h in range(heads)], target)
    names = [f"v{h}_{c}" for h in range(heads) for c in range(chans)]
    summed = soft.groupBy(F.col(target).alias("id")).agg(*[
        F.sum(F.col(f"m{h}") * F.col(f"m{heads + h * chans + c}")).alias(f"v{h}_{c}")
        for h in range(heads) for c in range(chans)])
    return g.nodes.join(summed, "id", "left").select(
        "*", vec.pack([F.coalesce(n, F.lit(0.0)) for n in names]).alias(out)).drop(*names)
