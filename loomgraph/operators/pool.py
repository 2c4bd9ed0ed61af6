"""Selection, coarsening and matching of graph nodes."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..core import mix, vec
from ..core.ranges import rank_in_group, top_k
from ..core.session import cut, new_folder, release
from ..graph import Graph
from .conv import graph_conv, le_conv
from .edges import add_remaining_self_loops, add_self_loops, coalesce_edges, relabel
from .propagate import group_softmax, propagate


def topk(nodes: DataFrame, score: str, ratio: float | int | None = 0.5, min_score: float | None = None,
         tol: float = 1e-7, group: str = "graph_id") -> DataFrame:
    """Nodes kept per graph, with ``rank`` (score desc, then id).

    ceil(ratio * n) for a fraction, min(k, n) for a count, or scores above
    min(graph maximum - tol, min_score).
    """
    order = [F.col(score).desc(), F.col("id")]
    if min_score is not None:
        top = nodes.groupBy(group).agg(F.max(score).alias("_top"))
        kept = nodes.join(top, group).filter(
            F.col(score) > F.least(F.col("_top") - tol, F.lit(min_score))).drop("_top")
        return rank_in_group(kept, [group], order, "rank")
    if isinstance(ratio, int):
        return top_k(nodes, [group], order, ratio, "rank")
    ranked = rank_in_group(nodes, [group], order, "rank")
    size = ranked.groupBy(group).agg(F.ceil(F.lit(ratio) * F.count("*")).alias("_k"))
    return ranked.join(size, group).filter(F.col("rank") < F.col("_k")).drop("_k")


def new_ids(kept: DataFrame, group: str = "graph_id") -> DataFrame:
    """(id, new_id): kept nodes renumbered graph by graph in rank order."""
    from ..core.ranges import global_index
    return global_index(kept.select("id", group, "rank"), [F.col(group), F.col("rank")], "new_id").select("id", "new_id")


def filter_adj(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges among kept nodes, renumbered."""
    return relabel(edges, mapping)


def topk_pooling(g: Graph, p: Sequence[float], ratio: float | int = 0.5, min_score: float | None = None,
                 multiplier: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Score tanh(x.p/|p|) (softmax per graph with ``min_score``), keep the top, gate features."""
    size = sum(v * v for v in p) ** 0.5
    raw = vec.dot(vec.parts("x", g.dim), [F.lit(float(v)) for v in p])
    if min_score is None:
        scored = g.nodes.withColumn("score", F.tanh(raw / size))
    else:
        scored = group_softmax(g.nodes.withColumn("score", raw), ["score"], "graph_id")
    return _gate(scored, g, ratio, min_score, multiplier)


def _gate(scored: DataFrame, g: Graph, ratio, min_score, multiplier: float) -> tuple[DataFrame, DataFrame]:
    kept = topk(scored, "score", ratio, min_score)
    kept = cut(kept.withColumn("x", vec.pack([c * F.col("score") * multiplier for c in vec.parts("x", g.dim)])))
    return kept, filter_adj(g.edges, new_ids(kept))


def sag_pooling(g: Graph, w_rel: Sequence[Sequence[float]], w_root: Sequence[Sequence[float]],
                ratio: float | int = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores from a one-channel graph convolution."""
    s = graph_conv(g, w_rel, w_root).select("id", F.tanh(F.col("out")[0]).alias("score"))
    return _gate(g.nodes.join(s, "id"), g, ratio, None, 1.0)


def asa_pooling(g: Graph, lin: Sequence[Sequence[float]], att: Sequence[float],
                le: tuple[Sequence, Sequence, Sequence], ratio: float | int = 0.5,
                slope: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Attention clusters around every node, fitness top-k, coarsened S^T A S.

    The two products run as joins on node ids; pairs emitted are the coarse edges' terms.
    """
    looped = Graph(g.nodes, add_remaining_self_loops(g.edges, g.nodes), g.dim)
    peak = propagate(looped, None, "max", out="_q")
    q = peak.withColumn("xq", vec.pack(vec.linear(vec.parts("_q", g.dim), lin))).drop("_q")
    e = looped.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("x").alias("_xj")), "src").join(
        q.select(F.col("id").alias("dst"), "xq"), "dst")
    raw = vec.dot(vec.parts("xq", g.dim) + vec.parts("_xj", g.dim), [F.lit(float(a)) for a in att])
    soft = cut(group_softmax(e.select("src", "dst", "w", "_xj", vec.leaky(raw, slope).alias("s")), ["s"], "dst"))
    x = soft.groupBy(F.col("dst").alias("id")).agg(F.array(*[
        F.sum(F.col("s") * c) for c in vec.parts("_xj", g.dim)]).alias("_cx"))
    clustered = g.nodes.join(x, "id").withColumn("x", F.col("_cx")).drop("_cx")
    fit = le_conv(Graph(clustered, looped.edges.withColumn("w", F.lit(1.0)), g.dim), *le).select(
        "id", vec.sigmoid(F.col("out")[0]).alias("score"))
    kept = topk(clustered.join(fit, "id"), "score", ratio)
    kept = cut(kept.withColumn("x", vec.pack([c * F.col("score") for c in vec.parts("x", g.dim)])))
    names = new_ids(kept)
    s = soft.select("src", F.col("dst").alias("id"), "s").join(names, "id").select("src", F.col("new_id").alias("c"), "s")
    half = looped.edges.join(s.select(F.col("src").alias("dst"), F.col("c").alias("b"), "s"), "dst").groupBy(
        "src", "b").agg(F.sum(F.col("w") * F.col("s")).alias("v"))
    coarse = half.join(s.select("src", F.col("c").alias("a"), "s"), "src").groupBy("a", "b").agg(
        F.sum(F.col("v") * F.col("s")).alias("w")).filter("a <> b")
    return kept, coarse.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


# coarsening by given clusters: clusters(id, cluster) ---------------------------------------------

def consecutive_cluster(clusters: DataFrame) -> DataFrame:
    """(cluster, new_id, rep): dense ids by sorted value; rep is the last node of the cluster."""
    reps = clusters.groupBy("cluster").agg(F.max("id").alias("rep"))
    return rank_in_group(reps, [], [F.col("cluster")], "new_id")


def pool_edge(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between clusters (id, new_id): loops dropped, parallel weights summed."""
    return coalesce_edges(relabel(edges, mapping).filter("src <> dst"))


def cluster_map(clusters: DataFrame) -> DataFrame:
    dense = consecutive_cluster(clusters)
    return clusters.join(dense.select("cluster", "new_id"), "cluster").select("id", "new_id")


def pool_nodes(nodes: DataFrame, mapping: DataFrame, dim: int, how: str = "mean",
               col: str = "x") -> DataFrame:
    agg = {"mean": F.avg, "max": F.max, "add": F.sum}[how]
    return nodes.join(mapping, "id").groupBy(F.col("new_id").alias("id")).agg(
        vec.reduce_vec(agg, col, dim).alias(col))


def pool_batch(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Graph of each cluster's last node."""
    return nodes.join(mapping, "id").groupBy(F.col("new_id").alias("id")).agg(
        F.max_by("graph_id", "id").alias("graph_id"))


def coarsen(g: Graph, clusters: DataFrame, how: str = "mean", pos_dim: int = 0) -> Graph:
    """Whole-graph pooling; positions are always averaged."""
    mapping = cut(cluster_map(clusters))
    nodes = pool_nodes(g.nodes, mapping, g.dim, how)
    if pos_dim:
        nodes = nodes.join(pool_nodes(g.nodes, mapping, pos_dim, "mean", "pos"), "id")
    if "graph_id" in g.nodes.columns:
        nodes = nodes.join(pool_batch(g.nodes, mapping), "id")
    return Graph(nodes, pool_edge(g.edges, mapping), g.dim)


def neighbor_pool(g: Graph, how: str = "mean") -> DataFrame:
    """Mean or max over the node and its in-neighbours."""
    return propagate(g.with_edges(add_self_loops(g.edges, g.nodes)), None, how).select("id", "out")


def voxel_grid(nodes: DataFrame, size: Sequence[float], dim: int, start: Sequence[float] | None = None,
               end: Sequence[float] | None = None, pos: str = "pos") -> DataFrame:
    """(id, cluster): mixed-radix cell number over the position and the graph id.

    Bounds default to the data's; one row of extremes comes back to fix the radixes.
    """
    has_graph = "graph_id" in nodes.columns
    aggs = [f(nodes[pos][k]).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(dim)]
    if start is None or end is None:
        row = nodes.agg(*aggs).first()
    lo = list(start) if start is not None else [row[f"lo{k}"] for k in range(dim)]
    hi = list(end) if end is not None else [row[f"hi{k}"] for k in range(dim)]
    cell, stride = F.lit(0).cast("bigint"), 1
    for k in range(dim):
        cell = cell + F.floor((F.col(pos)[k] - lo[k]) / size[k]) * stride
        stride *= int((hi[k] - lo[k]) / size[k]) + 1
    if has_graph:
        cell = cell + F.col("graph_id") * stride
    return nodes.select("id", cell.alias("cluster"))


def grid_sampling(nodes: DataFrame, size: Sequence[float], dim: int, x_dim: int = 0) -> DataFrame:
    """One row per voxel: mean position (and features), majority label (lowest on ties)."""
    cells = nodes.join(voxel_grid(nodes, size, dim), "id")
    aggs = [vec.reduce_vec(F.avg, "pos", dim).alias("pos")]
    if x_dim:
        aggs.append(vec.reduce_vec(F.avg, "x", x_dim).alias("x"))
    out = cells.groupBy("cluster").agg(*aggs)
    if "y" in nodes.columns:
        votes = cells.groupBy("cluster", "y").agg(F.count("*").alias("n")).groupBy("cluster").agg(
            F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("y"))
        out = out.join(votes, "cluster")
    return out


# greedy matching as rounds of locally dominant edges -----------------------------------------------

IN_ONE = 2_000_000   # edges that one task walks in order at a time


def dominant_matching(edges: DataFrame, nodes: DataFrame, order: Sequence[Column],
                      max_rounds: int = 10000) -> DataFrame:
    """(a, b) pairs of the greedy matching that takes edges in ``order``.

    In each round every edge that comes first at both its ends is taken at once. With a
    total order this gives exactly the sequential greedy result, round count aside.
    Ties by id make chains of edges that wait for each other, a round each: once a round leaves
    more than half of the edges, or few are left, the rest is taken in order (``_in_order``).
    ``edges`` needs src, dst and the order columns; loops match a node with itself.
    """
    key = F.struct(*order, F.col("src"), F.col("dst"))
    live = cut(edges.select("src", "dst", key.alias("k")))
    left, picked = live.count(), None
    for _ in range(max_rounds):
        if left <= IN_ONE:
            new = cut(_walk(live))
            return new if picked is None else picked.unionAll(new)
        ends = live.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "k")
        first = ends.groupBy("id").agg(F.min("k").alias("k"))
        wins = first.groupBy("k").agg(F.count("*").alias("n")).filter(
            (F.col("n") == 2) | (F.col("k.src") == F.col("k.dst")))
        new = cut(wins.select(F.col("k.src").alias("a"), F.col("k.dst").alias("b")))
        picked = new if picked is None else picked.unionAll(new)
        was, before = left, live
        live = cut(_untouched(live, new))
        left = live.count()
        release(before)
        if left > IN_ONE and 2 * left > was:
            return picked.unionAll(_in_order(live, left))
    return picked


def _untouched(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(
        gone.select(F.col("id").alias("dst")), "dst", "left_anti")


def _walk(edges: DataFrame) -> DataFrame:
    """(a, b) of the greedy matching of ``edges(src, dst, k)``, in one task that keeps the matched ids only."""
    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for f in frames:
            a, b = [], []
            for s, d in zip(f["src"].tolist(), f["dst"].tolist()):
                if s not in met and d not in met:
                    met.update((s, d))
                    a.append(s)
                    b.append(d)
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    by = [F.col(f"k.`{c}`") for c in edges.schema["k"].dataType.names]   # plain columns sort faster than a struct
    return edges.repartition(1).sortWithinPartitions(*by).select("src", "dst").mapInPandas(take, "a bigint, b bigint")


def _in_order(live: DataFrame, left: int) -> DataFrame:
    """The same for any number of edges: slices along ``k``, each walked once the pairs before it are known.

    A slice is read once and loses the edges of matched nodes before one task walks the rest; as more and
    more nodes are matched, more slices are taken together.
    """
    spark, folder = live.sparkSession, new_folder(live.sparkSession)
    count = -(-4 * left // IN_ONE)
    laid = live.repartitionByRange(count, "k").withColumn("slice", F.spark_partition_id())
    laid.write.partitionBy("slice").parquet(f"{folder}/live")
    release(live)
    at, width, picked = 0, 4, spark.createDataFrame([], "a bigint, b bigint")
    table = spark.read.schema(StructType([*live.schema, StructField("slice", IntegerType())])).parquet(f"{folder}/live")
    while at < count:
        some = cut(_untouched(table.filter(F.col("slice").between(at, at + width - 1)).drop("slice"), picked))
        n = some.count()
        if n > IN_ONE and width > 1:
            width //= 2
        else:
            _walk(some).write.mode("append").parquet(f"{folder}/picked")
            picked = spark.read.schema("a bigint, b bigint").parquet(f"{folder}/picked")
            at += width
            width *= 2 if 2 * n < IN_ONE else 1
        release(some)
    return picked


def matching_clusters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): matched nodes share the smaller id; the others keep their own."""
    m = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.least("a", "b").alias("c")),
        F.struct(F.col("b").alias("id"), F.least("a", "b").alias("c")))).alias("p")).select("p.*").distinct()
    return nodes.select("id").join(m, "id", "left").select("id", F.coalesce("c", "id").alias("cluster"))


def edge_scores(g: Graph, w: Sequence[float], how: str = "softmax", add: float = 0.5) -> DataFrame:
    """(src, dst, score): linear score of both ends' features, normalised per target, shifted."""
    s = g.nodes.select(F.col("id").alias("src"), F.col("x").alias("_a"))
    d = g.nodes.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    raw = vec.dot(vec.parts("_a", g.dim) + vec.parts("_b", g.dim), [F.lit(float(v)) for v in w])
    e = g.edges.join(s, "src").join(d, "dst").select("src", "dst", raw.alias("score"))
    if how == "softmax":
        e = group_softmax(e, ["score"], "dst")
    else:
        e = e.withColumn("score", F.tanh("score") if how == "tanh" else vec.sigmoid(F.col("score")))
    return e.withColumn("score", F.col("score") + add)


def edge_pooling(g: Graph, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract edges greedily by score. Returns nodes (x summed, times score), edges, (id, cluster)."""
    scores = cut(scores)
    pairs = cut(dominant_matching(scores, g.nodes, [(-F.col("score")).alias("neg")]))
    clusters = cut(matching_clusters(pairs, g.nodes))
    gain = pairs.join(scores.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score"), ["a", "b"]).select(
        F.least("a", "b").alias("cluster"), "score")
    x = g.nodes.join(clusters, "id").groupBy("cluster").agg(
        *[F.sum(c).alias(f"s{k}") for k, c in enumerate(vec.parts("x", g.dim))])
    nodes = x.join(gain, "cluster", "left").select(F.col("cluster").alias("id"), vec.pack(
        [F.col(f"s{k}") * F.coalesce("score", F.lit(1.0)) for k in range(g.dim)]).alias("x"),
        F.coalesce("score", F.lit(1.0)).alias("score"))
    linked = relabel(g.edges.select("src", "dst"), clusters.withColumnRenamed("cluster", "new_id")).distinct()
    return nodes, linked, clusters


def edge_unpool(nodes: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """Spread pooled features back: divided by the merge score."""
    return clusters.join(nodes.withColumnRenamed("id", "cluster"), "cluster").select(
        "id", vec.pack([c / F.col("score") for c in vec.parts("x", dim)]).alias("x"))


def graclus(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): heavy-edge matching, heaviest first, ties by a fixed hash of the ends."""
    e = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max("w").alias("w"))
    pairs = dominant_matching(e, nodes, [(-F.col("w")).alias("neg"), mix.mix("src", "dst").alias("h")])
    return matching_clusters(pairs, nodes)
