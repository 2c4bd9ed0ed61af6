"""Samplers, walks, negatives, splits and random graphs.

Every draw is a function of keys and a seed (``core.mix``), so re-run tasks draw the same
and plain SQL can repeat it. The distributions are those of the published samplers; their
number streams are not reproduced.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import mix
from ..core.ranges import global_index, rank_in_group, running, top_k
from ..core.session import cut
from .edges import both_ways, relabel_map, subgraph

TASK_DRAWS = 4_000_000   # jumps of a random graph that a task draws, about
MOST_TASKS = 100_000


# neighbour and subgraph samplers -------------------------------------------------------------

def neighbor_sampler(edges: DataFrame, seeds: DataFrame, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """(layer, src, dst): per hop at most ``size`` in-neighbours of each frontier node (-1 all).

    The hop's frontier is everything reached so far, as published. Order layers descending
    for outermost-first.
    """
    front = seeds.select("id").distinct()
    out = None
    for layer, size in enumerate(sizes):
        near = edges.select("src", "dst").join(front.select(F.col("id").alias("dst")), "dst", "left_semi")
        if size >= 0:
            near = top_k(near.withColumn("_d", mix.mix("src", "dst", seed=seed + layer)), ["dst"], [F.col("_d"), F.col("src")], size, "_r")
        near = cut(near.select(F.lit(layer).alias("layer"), "src", "dst"))
        out = near if out is None else out.unionAll(near)
        front = cut(front.unionAll(near.select(F.col("src").alias("id"))).distinct())
    return out


def random_parts(nodes: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    return nodes.select("id", F.pmod(mix.mix("id", seed=seed), F.lit(parts)).cast("int").alias("part"))


def random_node_subgraphs(edges: DataFrame, nodes: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """Edges inside each random node part, tagged with it."""
    p = random_parts(nodes, parts, seed)
    return edges.join(p.select(F.col("id").alias("src"), "part"), "src").join(
        p.select(F.col("id").alias("dst"), F.col("part").alias("_q")), "dst").filter("part = _q").drop("_q")


def saint_node_samples(edges: DataFrame, size: int, samples: int, seed: int = 0) -> DataFrame:
    """(sample, id): distinct sources of ``size`` edges drawn uniformly with replacement."""
    e = cut(global_index(edges.select("src", "dst"), [F.col("src"), F.col("dst")], "e"))
    n = e.count()
    draws = edges.sparkSession.range(samples * size).select(
        F.floor(F.col("id") / size).alias("sample"), F.pmod(mix.mix("id", seed=seed), F.lit(n)).alias("e"))
    return draws.join(e, "e").select("sample", F.col("src").alias("id")).distinct()


def saint_edge_samples(edges: DataFrame, size: int, samples: int, seed: int = 0) -> DataFrame:
    """(sample, id): ends of ``size`` edges with the largest ln(u)/p, p = sum of both ends' degrees
    (the published formula inverts the inverse degrees)."""
    s = edges.groupBy("src").agg(F.count("*").alias("_ds"))
    d = edges.groupBy("dst").agg(F.count("*").alias("_dd"))
    e = edges.select("src", "dst").join(s, "src").join(d, "dst").withColumn(
        "sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    key = F.log(mix.unit("src", "dst", "sample", seed=seed)) / (F.col("_ds") + F.col("_dd"))
    kept = top_k(e.withColumn("_k", key), ["sample"], [F.col("_k").desc(), F.col("src"), F.col("dst")], size, "_r")
    return kept.select("sample", F.explode(F.array("src", "dst")).alias("id")).distinct()


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0, walk: str = "walk") -> DataFrame:
    """(walk, step, id) of uniform walks from starts(walk, id); a node without out-edges stays.

    Neighbours are numbered once; each step is an equi-join on (node, drawn number).
    """
    lane = cut(rank_in_group(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")), ["at"], [F.col("next")], "r"))
    deg = lane.groupBy("at").agg(F.count("*").alias("d"))
    cur = starts.select(walk, F.col("id").alias("at"))
    out = cur.select(walk, F.lit(0).alias("step"), F.col("at").alias("id"))
    for k in range(1, length + 1):
        pick = cur.join(deg, "at", "left").withColumn("r", F.pmod(mix.mix(walk, F.lit(k), seed=seed), F.coalesce("d", F.lit(1))))
        cur = cut(pick.join(lane, ["at", "r"], "left").select(walk, F.coalesce("next", "at").alias("at")))
        out = out.unionAll(cur.select(walk, F.lit(k).alias("step"), F.col("at").alias("id")))
    return out


def biased_walks(edges: DataFrame, starts: DataFrame, length: int, p: float, q: float, seed: int = 0) -> DataFrame:
    """Second-order walks: return weight 1/p, common neighbours 1, others 1/q.

    Each step weighs the current node's neighbours and keeps the largest ln(u)/w - an exact
    weighted draw made by an aggregate, so a hub's neighbours never gather in one place.
    """
    lane = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    known = lane.select(F.col("at").alias("prev"), "next", F.lit(True).alias("_near"))
    cur = starts.select("walk", F.col("id").alias("at"), F.lit(None).cast("bigint").alias("prev"))
    out = cur.select("walk", F.lit(0).alias("step"), F.col("at").alias("id"))
    for k in range(1, length + 1):
        options = cur.join(lane, "at").join(known, ["prev", "next"], "left")
        w = F.when(F.col("prev").isNull(), 1.0).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("_near"), 1.0).otherwise(1 / q)
        key = F.log(mix.unit("walk", "next", F.lit(k), seed=seed)) / w
        best = options.groupBy("walk").agg(F.max_by("next", F.struct(key.alias("k"), F.col("next"))).alias("next"))
        cur = cut(cur.join(best, "walk", "left").select("walk", F.coalesce("next", "at").alias("_n"), F.col("at").alias("prev")).select(
            "walk", F.col("_n").alias("at"), "prev"))
        out = out.unionAll(cur.select("walk", F.lit(k).alias("step"), F.col("at").alias("id")))
    return out


def walk_contexts(walks: DataFrame, context: int) -> DataFrame:
    """(walk, start, pos, id): every window of ``context`` consecutive steps."""
    last = walks.agg(F.max("step")).first()[0]
    return walks.select("walk", F.explode(F.sequence(
        F.greatest(F.col("step") - (context - 1), F.lit(0)), F.least(F.col("step"), F.lit(last - context + 1)))).alias("start"),
        "step", "id").select("walk", "start", (F.col("step") - F.col("start")).alias("pos"), "id")


def metapath_walks(hops: Sequence[DataFrame], starts: DataFrame, seed: int = 0) -> DataFrame:
    """Walks whose k-th step uses the k-th edge table; a walk ends where it finds no edge (-1)."""
    cur = starts.select("walk", "id")
    out = cur.select("walk", F.lit(0).alias("step"), "id")
    for k, edges in enumerate(hops, 1):
        lane = rank_in_group(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), ["id"], [F.col("next")], "r")
        lane = cut(lane)
        deg = lane.groupBy("id").agg(F.count("*").alias("d"))
        pick = cur.join(deg, "id", "left").withColumn("r", F.pmod(mix.mix("walk", F.lit(k), seed=seed), F.coalesce("d", F.lit(1))))
        cur = cut(pick.join(lane, ["id", "r"], "left").select("walk", F.coalesce("next", F.lit(-1)).alias("id")))
        out = out.unionAll(cur.select("walk", F.lit(k).alias("step"), "id"))
    return out


def saint_walk_samples(edges: DataFrame, nodes: DataFrame, roots: int, length: int, samples: int, seed: int = 0) -> DataFrame:
    """(sample, id): nodes met by ``roots`` random walks per sample."""
    ids = cut(global_index(nodes.select("id"), [F.col("id")], "n"))
    n = ids.count()
    starts = nodes.sparkSession.range(samples * roots).select(F.col("id").alias("walk"), F.pmod(mix.mix("id", seed=seed), F.lit(n)).alias("n"))
    walks = random_walks(edges, starts.join(ids, "n").select("walk", "id"), length, seed + 1)
    return walks.select(F.floor(F.col("walk") / roots).alias("sample"), "id").distinct()


def saint_subgraphs(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Induced edges of every sample."""
    return edges.join(samples.select("sample", F.col("id").alias("src")), "src").join(
        samples.select("sample", F.col("id").alias("dst")), ["sample", "dst"]).select("sample", *edges.columns)


def saint_norms(edges: DataFrame, nodes: DataFrame, samples: DataFrame, n_samples: int) -> tuple[DataFrame, DataFrame]:
    """Node norm samples/(count N) (count 0 reads 0.1) and edge norm count(src)/count(edge)
    clipped to [0, 1e4] (0/0 reads 0.1)."""
    n = nodes.agg(F.count("*").alias("_N"))  # one row
    seen = samples.groupBy("id").agg(F.count("*").alias("c"))
    count = nodes.select("id").join(seen, "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("c"))
    node = count.crossJoin(F.broadcast(n)).select("id", (
        F.lit(float(n_samples)) / F.when(F.col("c") == 0, 0.1).otherwise(F.col("c")) / F.col("_N")).alias("norm"))
    used = saint_subgraphs(edges.select("src", "dst"), samples).groupBy("src", "dst").agg(F.count("*").alias("ec"))
    e = edges.select("src", "dst").join(used, ["src", "dst"], "left").join(count.withColumnRenamed("id", "src"), "src")
    norm = F.when(F.coalesce("ec", F.lit(0)) > 0, F.least(F.col("c") / F.col("ec"), F.lit(1e4))).when(F.col("c") > 0, 1e4).otherwise(0.1)
    return node, e.select("src", "dst", norm.alias("norm"))


def cluster_loader(edges: DataFrame, part: DataFrame, parts: Sequence[int]) -> DataFrame:
    """Edges with both ends in the chosen parts, links between those parts included."""
    return subgraph(edges, part.filter(F.col("part").isin(*parts)))


# negatives and splits -----------------------------------------------------------------------

def negative_edges(edges: DataFrame, n_nodes: int, k: int, seed: int = 0, undirected: bool = False) -> DataFrame:
    """Up to ``k`` node pairs that are no edges: oversampled draws, an anti join, the first k.

    Nodes are 0..n-1. The oversampling factor is the published abs(1/(1-1.1 E/N^2)). Undirected
    graphs that hold more than half of the pairs are not drawn from: all their free pairs are
    listed, about as many rows as there are edges, and the first k by hash are taken.
    """
    e = edges.select("src", "dst").distinct()
    if undirected:
        e = e.filter("src < dst")
    total = n_nodes * (n_nodes - 1) // 2 if undirected else n_nodes * n_nodes
    m = e.count()
    want = min(k // 2 if undirected else k, total - m)
    draws = int(want * abs(1 / (1 - 1.1 * m / total))) + 1
    pair = edges.sparkSession.range(draws).select(
        F.col("id").alias("draw"), F.pmod(mix.mix("id", seed=seed), F.lit(n_nodes)).alias("a"),
        F.pmod(mix.mix("id", seed=seed + 1), F.lit(n_nodes)).alias("b"))
    if undirected and 2 * m > total:
        at = edges.sparkSession.range(n_nodes * n_nodes).select(F.floor(F.col("id") / n_nodes).alias("src"), (F.col("id") % n_nodes).alias("dst"))
        pair = at.filter("src < dst").select(mix.mix("src", "dst", seed=seed).alias("draw"), "src", "dst")
    elif undirected:
        pair = pair.filter("a <> b").select("draw", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    else:
        pair = pair.select("draw", F.col("a").alias("src"), F.col("b").alias("dst"))
    free = pair.groupBy("src", "dst").agg(F.min("draw").alias("draw")).join(e, ["src", "dst"], "left_anti")
    kept = global_index(free, [F.col("draw"), F.col("src"), F.col("dst")], "at").filter(F.col("at") < want).select("src", "dst")
    return both_ways(kept) if undirected else kept


def structured_negatives(edges: DataFrame, n_nodes: int, seed: int = 0, rounds: int = 50) -> DataFrame:
    """(src, dst, neg): for each edge a node that is no neighbour of its source, redrawn on a hit.

    Edges that ``rounds`` draws leave open take the smallest node that is none of the source's
    neighbours; ``neg`` is null where the source has them all."""
    e = cut(edges.select("src", "dst").distinct())
    open_ = e
    out = None
    for k in range(rounds):
        drawn = open_.withColumn("neg", F.pmod(mix.mix("src", "dst", F.lit(k), seed=seed), F.lit(n_nodes)))
        hit = e.select("src", F.col("dst").alias("neg"))
        good = cut(drawn.join(hit, ["src", "neg"], "left_anti").select("src", "dst", "neg"))
        out = good if out is None else out.unionAll(good)
        open_ = cut(open_.join(good.select("src", "dst"), ["src", "dst"], "left_anti"))
        if open_.limit(1).count() == 0:
            return out
    near = rank_in_group(e.join(open_.select("src").distinct(), "src", "left_semi").filter(F.col("dst").between(0, n_nodes - 1)), ["src"], [F.col("dst")], "r")
    free = near.groupBy("src").agg(F.coalesce(F.min(F.when(F.col("dst") > F.col("r"), F.col("r"))), F.count("*")).alias("neg"))
    rest = open_.join(free, "src", "left").select("src", "dst", F.coalesce("neg", F.lit(0)).alias("neg"))
    rest = rest.withColumn("neg", F.when(F.col("neg") < n_nodes, F.col("neg")))
    return rest if out is None else out.unionAll(rest)


def batched_negatives(nodes: DataFrame, edges: DataFrame, per_edge: int = 1, seed: int = 0) -> DataFrame:
    """(graph_id, src, dst): per graph as many non-edges as drawn pairs allow, one draw per edge."""
    place = cut(rank_in_group(nodes.select("graph_id", "id"), ["graph_id"], [F.col("id")], "pos"))
    size = place.groupBy("graph_id").agg(F.count("*").alias("n"))
    g = edges.join(place.select(F.col("id").alias("src"), "graph_id"), "src").select("graph_id", "src", "dst").distinct()
    draw = g.join(size, "graph_id").select("graph_id", *[
        F.pmod(mix.mix("src", "dst", seed=seed + k), F.col("n")).alias(c) for k, c in enumerate(("a", "b"))]).distinct()
    a = place.select("graph_id", F.col("pos").alias("a"), F.col("id").alias("src"))
    b = place.select("graph_id", F.col("pos").alias("b"), F.col("id").alias("dst"))
    pairs = draw.join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"]).select("graph_id", "src", "dst")
    return pairs.join(g, ["graph_id", "src", "dst"], "left_anti")


def split_edges(edges: DataFrame, val: float, test: float, seed: int = 0) -> DataFrame:
    """(src, dst, split): upper-triangle edges in a drawn order, floor(ratio E) to val and test;
    train edges come back in both directions."""
    up = edges.filter("src < dst").select("src", "dst").distinct().withColumn("_d", mix.mix("src", "dst", seed=seed))
    ranked = global_index(up, [F.col("_d"), F.col("src"), F.col("dst")], "_r")
    n = up.agg(F.floor(F.count("*") * val).alias("_v"), F.floor(F.count("*") * test).alias("_t"))  # one row
    tagged = ranked.crossJoin(F.broadcast(n)).select("src", "dst", F.when(F.col("_r") < F.col("_v"), "val").when(
        F.col("_r") < F.col("_v") + F.col("_t"), "test").otherwise("train").alias("split"))
    return tagged.filter("split <> 'train'").unionByName(both_ways(tagged.filter("split = 'train'")))


# random and regular graphs --------------------------------------------------------------------

def grid_graph(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Eight-neighbour grid with loops, row-major ids."""
    r, c = F.floor(F.col("id") / width), F.col("id") % width
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    far = spark.range(height * width).select(F.col("id").alias("src"), r.alias("r"), c.alias("c"), step)
    return far.select("src", (F.col("r") + F.col("s.a")).alias("y"), (F.col("c") + F.col("s.b")).alias("x")).filter(
        (F.col("y").between(0, height - 1)) & (F.col("x").between(0, width - 1))).select(
        "src", (F.col("y") * width + F.col("x")).alias("dst"))


def grid_positions(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select("id", (F.col("id") % width).alias("x"), (F.lit(height - 1) - F.floor(F.col("id") / width)).alias("y"))


def _skips(prob: float, seed: int, n: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch of rows (src, at): the targets below ``n``, ``step`` jumps of the rows still open at a time."""
    def mixed(h: np.ndarray, key: np.ndarray) -> np.ndarray:   # a round of ``mix.mix``
        h = ((h + key % mix.PRIME) * mix.MULTIPLIERS[0] + 11) % mix.PRIME
        return (h * h % mix.PRIME + h * mix.MULTIPLIERS[1]) % mix.PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, at = (c.to_numpy() for c in batch.columns)
            drawn, k = mixed(np.full(len(src), seed + 7, np.int64), src), 0
            while len(src):
                u = (mixed(drawn[:, None], np.arange(k, k + step)[None]) + 1) / float(mix.PRIME + 1)
                path = at[:, None] + np.cumsum(1 + np.floor(np.log(u) / math.log(1 - prob)).astype(np.int64), axis=1)
                row, col = np.nonzero(path < n)
                yield pa.RecordBatch.from_arrays([pa.array(src[row]), pa.array(path[row, col])], ["src", "dst"])
                at, k = path[:, -1], k + step
                left = at < n
                src, at, drawn = src[left], at[left], drawn[left]

    return run


def gnp_edges(nodes: DataFrame, prob: float, directed: bool = False, seed: int = 0, max_gap: int = 64) -> DataFrame:
    """G(n, p) on ids 0..n-1 by geometric skips along each row.

    A row's edges are found by jumping ln(u)/ln(1-p) cells at a time, so work follows the
    edges, not the n^2 cells. Rows are dealt by id over as many tasks as their draws ask for; a task walks
    its rows ``max_gap`` jumps at a time and sends the targets on, so nothing is kept or stored between steps.
    """
    n = nodes.count()
    if 1 - prob == 1:
        return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    draws = prob * n * n if directed else prob * n * n / 2
    tasks = int(min(max(draws // TASK_DRAWS + 1, nodes.sparkSession.sparkContext.defaultParallelism), MOST_TASKS))
    start = F.lit(-1) if directed else F.col("id")  # undirected rows hold targets above the source
    rows = nodes.filter("id is not null").repartition(tasks, "id").select(F.col("id").cast("bigint").alias("src"), start.cast("bigint").alias("at"))
    out = rows.mapInArrow(_skips(prob, seed, n, max_gap), "src bigint, dst bigint").filter("src <> dst")
    return out if directed else both_ways(out)


def block_model_edges(nodes: DataFrame, probs: Sequence[Sequence[float]], seed: int = 0) -> DataFrame:
    """Undirected block model on nodes(id, block): thinned draws of the densest block's G(n, p)."""
    top = max(max(r) for r in probs)
    e = gnp_edges(nodes.select("id"), top, True, seed).filter("src < dst")
    b = nodes.select(F.col("id").alias("src"), F.col("block").alias("_a")), nodes.select(F.col("id").alias("dst"), F.col("block").alias("_b"))
    table = F.lit(None).cast("double")
    for i, row in enumerate(probs):
        for j, v in enumerate(row):
            table = F.when((F.col("_a") == i) & (F.col("_b") == j), float(v) / top).otherwise(table)
    kept = e.join(b[0], "src").join(b[1], "dst").filter(mix.unit("src", "dst", seed=seed + 1) < table)
    return both_ways(kept.select("src", "dst"))


def preferential_edges(nodes: DataFrame, m: int, seed: int = 0, depth: int = 64) -> DataFrame:
    """Preferential attachment without a sequential pass.

    Write all edge ends in one list (source of edge e at 2e, target at 2e+1); each target
    copies a uniformly drawn earlier slot, which is attachment by degree. A slot's chain of
    copies ends at a source, and every row resolves its own chain from the hash.
    """
    ends = nodes.select(F.explode(F.sequence(F.col("id") * m, F.col("id") * m + (m - 1))).alias("e"))
    def follow(slot, _):
        return F.when(slot % 2 == 0, slot).otherwise(F.pmod(mix.mix(slot, seed=seed), F.greatest(slot, F.lit(1))))
    slot = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.col("e") * 2 + 1, follow)
    out = ends.select(F.floor(F.col("e") / m).alias("src"), F.floor(slot / (2 * m)).alias("dst"))
    return both_ways(out.filter("src <> dst")).distinct()
