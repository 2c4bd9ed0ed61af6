"""Dense-adjacency layers and poolings over batched small graphs.

A padded batch is kept as (graph_id, i, ...) rows; adjacency rows come from
``to_dense_adj``. The products are aggregates per graph over edges that exist, so padding
is never multiplied out.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..graph import Graph
from .conv import done, plus
from .propagate import propagate, weighted

Matrix = Sequence[Sequence[float]]
EPS = 1e-15


def _diag(g: Graph, value: float | None) -> Graph:
    """Set every diagonal cell to ``value`` (None keeps the table)."""
    if value is None:
        return g
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(value).alias("w"))
    return g.with_edges(g.edges.select("src", "dst", "w").filter("src <> dst").unionAll(loops))


def _rowsum(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_d"))


def _times(g: Graph, how: Callable = weighted, out: str = "out") -> DataFrame:
    """A @ X: row i gathers x_j over its cells (i, j)."""
    return propagate(g, how, "add", flow="target_to_source", out=out)


def dense_gcn_conv(g: Graph, w: Matrix, b: Sequence[float] | None = None, improved: bool = False) -> DataFrame:
    """Diagonal overwritten with 1 (2 if improved), row degree at least 1."""
    base = _diag(g, 2.0 if improved else 1.0)
    d = _rowsum(base).select("id", (1 / F.sqrt(F.greatest("_d", F.lit(1.0)))).alias("_r"))
    nodes = base.nodes.join(d, "id").withColumn("x", vec.pack(
        [F.col("_r") * c for c in vec.linear(vec.parts("x", g.dim), w)]))
    got = _times(Graph(nodes, base.edges, len(w[0])))
    out = [F.col("_r") * c for c in vec.parts("out", len(w[0]))]
    return done(got, [c + F.lit(float(v)) for c, v in zip(out, b)] if b else out)


def dense_gin_conv(g: Graph, mlp: Callable, eps: float = 0.0, add_loop: bool = True) -> DataFrame:
    got = _times(g)
    out = vec.parts("out", g.dim)
    if add_loop:
        out = plus(out, [(1 + eps) * c for c in vec.parts("x", g.dim)])
    return done(got, mlp(out))


def dense_graph_conv(g: Graph, w_rel: Matrix, w_root: Matrix, aggr: str = "add",
                     size: int | None = None) -> DataFrame:
    """add, mean over the row degree (at least 1), or max over features as published."""
    got = _times(g)
    out = vec.parts("out", g.dim)
    if aggr == "mean":
        got = got.join(_rowsum(g), "id", "left")
        out = [c / F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(1.0)) for c in out]
    elif aggr == "max":
        top = F.greatest(*out)
        out = [top] * g.dim
    return done(got, plus(vec.linear(out, w_rel), vec.linear(vec.parts("x", g.dim), w_root)))


def dense_sage_conv(g: Graph, w_rel: Matrix, w_root: Matrix, normalize: bool = False) -> DataFrame:
    got = _times(g).join(_rowsum(g), "id", "left")
    mean = [c / F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(1.0)) for c in vec.parts("out", g.dim)]
    out = plus(vec.linear(mean, w_rel), vec.linear(vec.parts("x", g.dim), w_root))
    if normalize:
        size = F.greatest(vec.norm2(out), F.lit(1e-12))
        out = [c / size for c in out]
    return done(got, out)


# soft cluster assignment: nodes carry ``s`` ARRAY of k logits -------------------------------------

def soft_assign(nodes: DataFrame, k: int) -> DataFrame:
    top = F.greatest(*vec.parts("s", k)) if k > 1 else F.col("s")[0]
    e = [F.exp(c - top) for c in vec.parts("s", k)]
    return nodes.withColumn("s", vec.pack([c / vec.add_all(e) for c in e]))


def _pooled(g: Graph, k: int) -> tuple[DataFrame, DataFrame]:
    """Per graph S^T X (k x dim) and S^T A S (k x k), flattened row by row."""
    s, x = vec.parts("s", k), vec.parts("x", g.dim)
    sx = g.nodes.groupBy("graph_id").agg(F.array(*[F.sum(a * c) for a in s for c in x]).alias("x"))
    a = g.nodes.select(F.col("id").alias("src"), "graph_id", F.col("s").alias("_a"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("s").alias("_b"))
    e = g.edges.join(a, "src").join(b, "dst")
    sas = e.groupBy("graph_id").agg(F.array(*[
        F.sum(F.col("w") * p * q) for p in vec.parts("_a", k) for q in vec.parts("_b", k)]).alias("adj"))
    return sx, sas


def diff_pool(g: Graph, k: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per graph x and adj, one row of losses).

    |A - S S^T|^2 = sum A^2 - 2 sum A_ij s_i.s_j + sum_graph |S^T S|^2, so no n x n table is
    made. Loss denominators use ``size`` padded rows per graph.
    """
    nodes = soft_assign(g.nodes, k)
    g = g.with_nodes(nodes)
    sx, sas = _pooled(g, k)
    zero = F.array(*[F.lit(0.0)] * (k * k))
    out = sx.join(sas, "graph_id", "left").withColumn("adj", F.coalesce("adj", zero))
    s = vec.parts("s", k)
    gram = nodes.groupBy("graph_id").agg(F.array(*[F.sum(a * b) for a in s for b in s]).alias("_g"), F.count("*").alias("_n"))
    shape = gram.agg(F.sum(vec.dot(vec.parts("_g", k * k), vec.parts("_g", k * k))).alias("gram"),
                     F.count("*").alias("graphs"), F.max("_n").alias("size"))
    ent = nodes.agg(F.sum(vec.add_all([-c * F.log(c + EPS) for c in s])).alias("ent"))
    a = nodes.select(F.col("id").alias("src"), F.col("s").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("s").alias("_b"))
    cells = g.edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    cross = cells.join(a, "src").join(b, "dst").agg(F.sum(F.col("w") * F.col("w") - 2 * F.col("w") * vec.dot(
        vec.parts("_a", k), vec.parts("_b", k))).alias("cross"))
    n = F.col("size") if size is None else F.lit(size)
    losses = shape.crossJoin(ent).crossJoin(cross).select(  # three one-row tables
        (F.sqrt(F.col("gram") + F.col("cross")) / (F.col("graphs") * n * n)).alias("link_loss"),
        (F.col("ent") / (F.col("graphs") * n)).alias("ent_loss"))
    return out, losses


def mincut_pool(g: Graph, k: int) -> tuple[DataFrame, DataFrame]:
    """(per graph x and normalised adj with zero diagonal, one row of mean losses)."""
    nodes = soft_assign(g.nodes, k)
    g = g.with_nodes(nodes)
    sx, sas = _pooled(g, k)
    s = vec.parts("s", k)
    deg = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_d"))
    per = nodes.join(deg, "id", "left").groupBy("graph_id").agg(
        F.sum(F.coalesce("_d", F.lit(0.0)) * vec.dot(s, s)).alias("_den"),
        F.array(*[F.sum(a * b) for a in s for b in s]).alias("_ss"))
    m = sx.join(sas, "graph_id").join(per, "graph_id")
    cell = lambda a, b: F.col("adj")[a * k + b]
    num = vec.add_all([cell(a, a) for a in range(k)])
    size = vec.norm2(vec.parts("_ss", k * k))
    ortho = vec.norm2([F.col("_ss")[a * k + b] / size - (1 / k ** 0.5 if a == b else 0.0)
                       for a in range(k) for b in range(k)])
    rows = [vec.add_all([cell(a, b) for b in range(k) if b != a]) if k > 1 else F.lit(0.0) for a in range(k)]
    root = [F.sqrt(r) + EPS for r in rows]
    adj = [F.lit(0.0) if a == b else cell(a, b) / root[b] / root[a] for a in range(k) for b in range(k)]
    m = m.withColumns({"mincut": -(num / F.col("_den")), "ortho": ortho, "_adj": vec.pack(adj)})
    losses = m.agg(F.avg("mincut").alias("mincut_loss"), F.avg("ortho").alias("ortho_loss"))
    return m.select("graph_id", "x", F.col("_adj").alias("adj")), losses
