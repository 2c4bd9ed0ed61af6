"""Nearest-neighbour and radius joins over feature vectors, exact and without cross joins.

Points go to the nearest of a few pivots (a bounded sample). For a query cell, triangle
bounds on the distance to the pivots tell which points of the other cells can still
matter, so the rest is never shipped. Cells then split into blocks of bounded size by a
key hash - a cell holding a third of all points becomes many tasks - and each pair of
blocks returns at most k rows per query before the final per-query selection.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import mix, vec
from ..core.ranges import top_k
from ..core.session import cut
from ..graph import Graph

PIVOTS = 24
QUERY_BLOCK = 2048
POINT_BLOCK = 8192


def _with_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, d): nearest pivot and the distance to it."""
    def assign(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy()) if len(v) else np.zeros((0, pivots.shape[1]))
        d = np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "d": d[np.arange(len(cell)), cell]})
    udf = F.pandas_udf(assign, "cell bigint, d double")
    return points.withColumn("_c", udf("v")).select("id", "v", "_c.cell", "_c.d")


def _candidates(x: DataFrame, y: DataFrame, k: int | None, r: float | None) -> tuple[DataFrame, DataFrame]:
    """Query rows by cell, and the point rows each query cell still has to look at."""
    spark = x.sparkSession
    rows = x.orderBy(mix.mix("id", seed=17), "id").limit(PIVOTS).select("v").collect()  # bounded
    pivots = np.array([row[0] for row in rows], dtype=float)
    xs, ys = cut(_with_cells(x, pivots)), cut(_with_cells(y, pivots))
    reach = dict(ys.groupBy("cell").agg(F.max("d")).collect())  # at most PIVOTS rows
    apart = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1))
    near = None
    if r is None:
        # the k points closest to each pivot bound the k-th distance of every query
        near = top_k(xs.select("cell", "d", "id"), ["cell"], [F.col("d"), F.col("id")], k).select(
            "cell", "d").collect()  # at most PIVOTS * k rows
    bounds = []
    for i, u in reach.items():
        if r is None:
            upper = sorted(u + apart[i, c] + d for c, d in near)
            limit = upper[k - 1] if len(upper) >= k else math.inf
        else:
            limit = r
        slack = 1e-9 * (1 + u + (0 if math.isinf(limit) else limit))
        for j in range(len(pivots)):
            bounds.append((int(i), j, float(apart[i, j] - u - limit - slack), float(apart[i, j] + u + limit + slack)))
    table = spark.createDataFrame(bounds, "cell bigint, xc bigint, lo double, hi double")
    cand = xs.withColumnRenamed("cell", "xc").join(F.broadcast(table), "xc").filter(  # PIVOTS^2 rows
        (F.col("d") >= F.col("lo")) & (F.col("d") <= F.col("hi"))).select("cell", "id", "v")
    return ys.select("cell", "id", "v"), cand


def _nearest_rows(a: np.ndarray, b: np.ndarray, keep: int, limit: float):
    """(query row, point row, squared distance) of each query's ``keep`` nearest within ``limit``,
    plus ties. The fast product form picks candidates with a slack over its rounding; those are
    then measured exactly."""
    bb = (b * b).sum(axis=1)
    slack = 1e-9 * (1.0 + np.abs(bb).max())
    for lo in range(0, len(a), 256):
        part = a[lo:lo + 256]
        d = (part * part).sum(axis=1)[:, None] + bb[None, :] - 2.0 * part @ b.T
        edge = np.partition(d, keep - 1, axis=1)[:, keep - 1] if keep < len(b) else np.full(len(part), np.inf)
        rows, cols = np.nonzero(d <= np.minimum(edge, limit)[:, None] + slack)
        yield lo + rows, cols, ((part[rows] - b[cols]) ** 2).sum(axis=1)


def _block_kernel(k: int, r: float | None, skip_self: bool):
    limit = math.inf if r is None else r * r

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ys, xs, ds = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
        if len(q) and len(p):
            q, p = q.sort_values("cell"), p.sort_values("cell")
            a, b = np.stack(q["v"].to_numpy()), np.stack(p["v"].to_numpy())
            qi, pi = q["id"].to_numpy(), p["id"].to_numpy()
            qc, pc = q["cell"].to_numpy(), p["cell"].to_numpy()
            cells = np.intersect1d(qc, pc)
            spans = [np.searchsorted(c, cells, side) for c in (qc, pc) for side in ("left", "right")]
            for q0, q1, p0, p1 in zip(*spans):
                keep = min(k + (1 if skip_self else 0), p1 - p0)
                for rows, cols, d in _nearest_rows(a[q0:q1], b[p0:p1], keep, limit):
                    ys.append(qi[q0 + rows]), xs.append(pi[p0 + cols]), ds.append(d)
        y, x, d = np.concatenate(ys), np.concatenate(xs), np.concatenate(ds)
        ok = d <= limit
        if skip_self:
            ok &= y != x
        y, x, d = y[ok], x[ok], d[ok]
        order = np.lexsort((x, d, y))
        y, x, d = y[order], x[order], d[order]
        rank = np.arange(len(y)) - np.searchsorted(y, y)
        return pd.DataFrame({"y": y, "x": x, "d2": d})[rank < k]
    return nearest


def _join_blocks(queries: DataFrame, points: DataFrame, k: int, r: float | None, skip_self: bool) -> DataFrame:
    """queries/points(cell, id, v) -> (y, x, d2, rank), the k nearest per query.

    A large cell splits into query x point blocks; small cells share a task with others.
    """
    q, p = cut(queries), cut(points)
    packs = max(1, -(-p.count() // POINT_BLOCK))
    size = q.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq")).join(
        p.groupBy("cell").agg(F.ceil(F.count("*") / POINT_BLOCK).cast("int").alias("np")), "cell").withColumn(
        "pack", F.when((F.col("nq") == 1) & (F.col("np") == 1), -1 - F.pmod(F.xxhash64("cell"), F.lit(packs))).otherwise(F.col("cell")))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qb = q.join(size, "cell").select("pack", "cell", "id", "v", F.pmod(mix.mix("id"), F.col("nq")).cast("int").alias("qb"), span("np").alias("pb"))
    pb = p.join(size, "cell").select("pack", "cell", "id", "v", F.pmod(mix.mix("id"), F.col("np")).cast("int").alias("pb"), span("nq").alias("qb"))
    key = ["pack", "qb", "pb"]
    # fresh column identities: both sides may stem from one table
    qb, pb = (df.select(*[F.col(c).alias(c) for c in (*key, "cell", "id", "v")]) for df in (qb, pb))
    hits = qb.groupBy(*key).cogroup(pb.groupBy(*key)).applyInPandas(
        _block_kernel(k, r, skip_self), "y bigint, x bigint, d2 double")
    return top_k(hits, ["y"], [F.col("d2"), F.col("x")], k)


def _unit(points: DataFrame) -> DataFrame:
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return points.withColumn("v", F.transform("v", lambda c: c / F.when(n > 0, n).otherwise(1.0)))


def _prepare(points: DataFrame, col: str, group: str | None, cosine: bool) -> DataFrame:
    p = points.select("id", F.col(col).alias("v"), *([F.col(group).alias("cell")] if group else []))
    return _unit(p) if cosine else p


def knn(x: DataFrame, y: DataFrame, k: int, col: str = "x", group: str | None = None,
        cosine: bool = False, skip_self: bool = False) -> DataFrame:
    """(y, x, d2, rank): the k points of ``x`` nearest to each row of ``y``, ties by id."""
    xs, ys = _prepare(x, col, group, cosine), _prepare(y, col, group, cosine)
    if group is None:
        ys, xs = _candidates(xs, ys, k + (1 if skip_self else 0), None)
    return _join_blocks(ys, xs, k, None, skip_self)


def knn_graph(x: DataFrame, k: int, col: str = "x", group: str | None = None, loop: bool = False,
              flow: str = "source_to_target", cosine: bool = False) -> DataFrame:
    """(src, dst, d2): neighbours point at the centre, or away with the other flow."""
    near = knn(x, x, k, col, group, cosine, skip_self=not loop)
    s, d = ("x", "y") if flow == "source_to_target" else ("y", "x")
    return near.select(F.col(s).alias("src"), F.col(d).alias("dst"), "d2", "rank")


def radius(x: DataFrame, y: DataFrame, r: float, col: str = "x", group: str | None = None,
           max_num_neighbors: int = 32, skip_self: bool = False) -> DataFrame:
    """(y, x, d2, rank): points within ``r``; past the neighbour limit the nearest stay."""
    xs, ys = _prepare(x, col, group, False), _prepare(y, col, group, False)
    if group is None:
        ys, xs = _candidates(xs, ys, None, r)
    return _join_blocks(ys, xs, max_num_neighbors, r, skip_self)


def radius_graph(x: DataFrame, r: float, col: str = "x", group: str | None = None, loop: bool = False,
                 max_num_neighbors: int = 32, flow: str = "source_to_target") -> DataFrame:
    near = radius(x, x, r, col, group, max_num_neighbors, skip_self=not loop)
    s, d = ("x", "y") if flow == "source_to_target" else ("y", "x")
    return near.select(F.col(s).alias("src"), F.col(d).alias("dst"), "d2", "rank")


def nearest(x: DataFrame, y: DataFrame, col: str = "x", group: str | None = None) -> DataFrame:
    """(id, cluster): nearest row of ``y`` for each row of ``x``."""
    return knn(y, x, 1, col, group).select(F.col("y").alias("id"), F.col("x").alias("cluster"))


def knn_interpolate(x: DataFrame, y: DataFrame, k: int, dim: int, pos: str = "pos") -> DataFrame:
    """Features of ``x`` spread to ``y`` by inverse squared distance over k neighbours."""
    near = knn(x, y, k, pos).select(F.col("x").alias("id"), "y", (1 / F.greatest("d2", F.lit(1e-16))).alias("w"))
    return near.join(x.select("id", F.col("x").alias("f")), "id").groupBy(F.col("y").alias("id")).agg(
        F.array(*[F.sum(F.col("w") * c) / F.sum("w") for c in vec.parts("f", dim)]).alias("x"))


def farthest_points(nodes: DataFrame, dim: int, ratio: float, col: str = "pos", group: str = "graph_id") -> DataFrame:
    """(graph, id, step): ceil(ratio n) points per graph, each the farthest from those before.

    Starts at the smallest id. All graphs advance together, one aggregate and one join per
    step; the number of steps is that of the largest graph's sample.
    """
    size = nodes.groupBy(group).agg(F.ceil(F.lit(ratio) * F.count("*")).alias("_k"))
    state = cut(nodes.join(size, group).select(group, "id", F.col(col).alias("p"), "_k", F.lit(math.inf).alias("m")))
    steps = state.agg(F.max("_k")).first()[0] or 0
    chosen = None
    for step in range(steps):
        live = state.filter(F.col("_k") > step)
        pick = cut(live.groupBy(group).agg(F.max_by(F.struct("id", "p"), F.struct(
            F.col("m"), -F.col("id"))).alias("c")).select(group, "c.id", F.col("c.p").alias("c")))
        new = pick.select(group, "id", F.lit(step).alias("step"))
        chosen = new if chosen is None else chosen.unionAll(new)
        gap = vec.add_all([(a - b) * (a - b) for a, b in zip(vec.parts("p", dim), vec.parts("c", dim))])
        state = cut(state.join(pick.select(group, "c"), group).withColumn("m", F.least("m", gap)).drop("c"))
    return chosen


def dynamic_edge_conv(g: Graph, k: int, h, col: str = "x", group: str | None = None) -> DataFrame:
    """Nearest neighbours in feature space, then an edge convolution over them."""
    from .conv import edge_conv
    return edge_conv(g.with_edges(knn_graph(g.nodes, k, col, group, loop=True)), h)
