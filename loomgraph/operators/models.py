"""Iterative graph algorithms and model pieces with given weights."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..core.session import cut
from ..graph import Graph
from .conv import done, graph_conv, plus, scaled
from .edges import add_self_loops, remove_self_loops
from .propagate import propagate, weighted
from .reduce import gcn_norm


def label_propagation(g: Graph, classes: int, steps: int, alpha: float, label: str = "y", mask: str = "mask",
                      low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(id, out): y <- clamp(alpha A y + (1 - alpha) y0); one-hot labels where masked, else 0."""
    start = vec.pack([((F.col(label) == c) & F.col(mask)).cast("double") for c in range(classes)])
    return smooth(g, g.nodes.select("id", start.alias("x")), classes, steps, alpha, low, high)


def smooth(g: Graph, start: DataFrame, dim: int, steps: int, alpha: float, low: float, high: float,
           fixed: DataFrame | None = None) -> DataFrame:
    """Damped propagation of start(id, x) with clamping; rows of fixed(id, x) are reset each step."""
    norm = gcn_norm(g.edges, g.nodes, loops=False)
    cur = start.select("id", "x", F.col("x").alias("x0"))
    if fixed is not None:
        cur = cur.join(fixed.select("id", F.col("x").alias("_fix")), "id", "left")
    for k in range(1, steps + 1):
        got = propagate(Graph(cur, norm, dim), weighted, out="_p")
        nxt = plus(scaled(vec.parts("_p", dim), alpha), scaled(vec.parts("x0", dim), 1 - alpha))
        new = vec.pack([F.least(F.greatest(c, F.lit(low)), F.lit(high)) for c in nxt])
        if fixed is not None:
            new = F.coalesce("_fix", new)
        cur = got.withColumn("x", new).drop("_p")
        if k % 3 == 0 and k < steps:
            cur = cut(cur)
    return cur.select("id", F.col("x").alias("out"))


def correct_and_smooth(g: Graph, soft: DataFrame, classes: int, correct_steps: int, correct_alpha: float,
                       smooth_steps: int, smooth_alpha: float, label: str = "y", mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """(corrected, smoothed) predictions from soft(id, x); residuals spread with autoscaling:
    scale = (mean |error| of the masked rows) / |spread error| of the row, 1 where infinite or above 1000."""
    truth = g.nodes.select("id", vec.pack([(F.col(label) == c).cast("double") for c in range(classes)]).alias("t"), mask)
    base = cut(soft.join(truth, "id"))
    err = base.select("id", vec.pack([F.when(F.col(mask), t - x).otherwise(0.0) for t, x in zip(
        vec.parts("t", classes), vec.parts("x", classes))]).alias("x"))
    spread = smooth(g, err, classes, correct_steps, correct_alpha, -1.0, 1.0)
    size = lambda c: vec.add_all([F.abs(p) for p in vec.parts(c, classes)])
    sigma = err.join(truth.filter(mask), "id", "left_semi").agg(F.avg(size("x")).alias("_s"))  # one row
    joined = base.join(spread, "id").crossJoin(F.broadcast(sigma))
    raw = F.when(size("out") > 0, F.col("_s") / size("out")).otherwise(1.0)
    k = F.when(raw > 1000, 1.0).otherwise(raw)
    fixed = cut(joined.select("id", mask, "t", vec.pack([x + k * e for x, e in zip(
        vec.parts("x", classes), vec.parts("out", classes))]).alias("x")))
    start = fixed.select("id", F.when(F.col(mask), F.col("t")).otherwise(F.col("x")).alias("x"))
    return fixed.select("id", F.col("x").alias("out")), smooth(g, start, classes, smooth_steps, smooth_alpha, 0.0, 1.0)


def inner_product_decoder(z: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """(src, dst, score): sigmoid(z_src . z_dst)"""
    a = z.select(F.col("id").alias("src"), F.col("x").alias("_a"))
    b = z.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select(
        "src", "dst", vec.sigmoid(vec.dot(vec.parts("_a", dim), vec.parts("_b", dim))).alias("score"))


def reconstruction_metrics(z: DataFrame, pos: DataFrame, neg: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(auc, average precision) of decoded positive against negative pairs."""
    from ..core.ranges import running
    from .metrics import roc_auc
    scored = inner_product_decoder(z, pos, dim).withColumn("label", F.lit(1)).unionByName(
        inner_product_decoder(z, neg, dim).withColumn("label", F.lit(0)))
    steps = scored.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    run = running(steps, [], [F.col("score").desc()], {"tp": F.col("p"), "seen": F.col("n")})
    ap = run.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("ap"))
    return roc_auc(scored), ap


def reconstruction_loss(z: DataFrame, pos: DataFrame, neg: DataFrame, dim: int, eps: float = 1e-15) -> DataFrame:
    p = inner_product_decoder(z, pos, dim).agg((-F.avg(F.log(F.col("score") + eps))).alias("a"))
    n = inner_product_decoder(z, neg, dim).agg((-F.avg(F.log(1 - F.col("score") + eps))).alias("b"))
    return p.crossJoin(n).select((F.col("a") + F.col("b")).alias("loss"))  # two one-row tables


def kl_loss(mu: list[Column], logstd: list[Column]) -> Column:
    """-1/2 mean over rows of sum(1 + 2 s - mu^2 - e^(2 s)), as an aggregate."""
    return -0.5 * F.avg(vec.add_all([1 + 2 * s - m * m - F.exp(2 * s) for m, s in zip(mu, logstd)]))


def path_triplets(edges: DataFrame) -> DataFrame:
    """(k, j, i) of every two-step path k -> j -> i with k <> i."""
    return edges.select(F.col("src").alias("k"), F.col("dst").alias("j")).join(
        edges.select(F.col("src").alias("j"), F.col("dst").alias("i")), "j").filter("k <> i").select("k", "j", "i")


def augment_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(A + I)^2 without its diagonal."""
    from .transforms import matmul
    a = add_self_loops(remove_self_loops(edges), nodes)
    return matmul(a, a).filter("src <> dst")


def jumping_knowledge(nodes: DataFrame, layers: Sequence[str], dim: int, mode: str = "cat") -> DataFrame:
    """Concatenate the layer outputs or take their channel-wise maximum."""
    if mode == "cat":
        return done(nodes, [c for n in layers for c in vec.parts(n, dim)])
    return done(nodes, [F.greatest(*[F.col(n)[k] for n in layers]) for k in range(dim)])


def deep_gcn_layer(g: Graph, conv, norm, act, block: str = "res+") -> DataFrame:
    """Residual wrappers around conv(graph) -> (id, out): res+, res, dense, plain."""
    x = vec.parts("x", g.dim)
    if block == "res+":
        pre = g.with_nodes(norm(g.nodes.withColumn("_x0", F.col("x"))))
        h = conv(pre.with_nodes(pre.nodes.withColumn("x", vec.pack([act(c) for c in x]))))
        joined = g.nodes.join(h.select("id", "out"), "id")
        return done(joined, plus(x, vec.parts("out", g.dim)))
    h = norm(conv(g).select("id", F.col("out").alias("x"))).select("id", F.col("x").alias("_h"))
    out = [act(c) for c in vec.parts("_h", g.dim)]
    joined = g.nodes.join(h, "id")
    return done(joined, {"res": plus(x, out), "dense": x + out, "plain": out}[block])


def schnet_interaction(g: Graph, dist: Column, cutoff: float, filters: Sequence[Sequence[float]], gaussians: int) -> DataFrame:
    """Continuous-filter convolution: x_j times a filter of the distance basis with cosine cutoff."""
    import math
    from ..functions.scalar import gaussian_smearing
    basis = gaussian_smearing(dist, 0.0, cutoff, gaussians)
    gate = 0.5 * (F.cos(dist * math.pi / cutoff) + 1.0)
    return propagate(g, lambda j, i: [x * w * gate for x, w in zip(j.vec(), vec.linear(basis, filters))]).select("id", "out")


def graph_classifier(nodes: DataFrame, edges: DataFrame, info: DataFrame, dim: int, info_cols: Sequence[str],
                     conv1, conv2, head: Sequence[tuple]) -> DataFrame:
    """(graph_id, label, scores): two graph convolutions, per-graph maximum of both outputs, the
    graph's own features joined by id, then dense layers; the label is the best class."""
    h1 = graph_conv(Graph(nodes, edges, dim), *conv1)
    w1 = len(conv1[0][0])
    n1 = nodes.select("id", "graph_id").join(h1.select("id", vec.pack([vec.relu(c) for c in vec.parts("out", w1)]).alias("x")), "id")
    w2 = len(conv2[0][0])
    h2 = graph_conv(Graph(n1, edges, w1), *conv2).select("id", vec.pack([vec.relu(c) for c in vec.parts("out", w2)]).alias("x2"))
    pooled = n1.join(h2, "id").groupBy("graph_id").agg(vec.reduce_vec(F.max, "x", w1).alias("a"), vec.reduce_vec(F.max, "x2", w2).alias("b"))
    joined = pooled.join(info, "graph_id")
    z = vec.parts("a", w1) + vec.parts("b", w2) + [F.col(c).cast("double") for c in info_cols]
    for n, (w, b) in enumerate(head):
        z = vec.linear(z, w, b)
        if n < len(head) - 1:
            joined = joined.withColumn(f"_z{n}", vec.pack([vec.relu(c) for c in z]))
            z = vec.parts(f"_z{n}", len(b))
    joined = joined.withColumn("scores", vec.pack(z))
    return joined.select("graph_id", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("label"), "scores")
