"""Feature, position and structure transforms on graph tables."""
from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import mix, vec
from ..core.ranges import global_index, running, top_k
from ..core.session import cut, release
from ..graph import Graph
from .edges import both_ways, coalesce_edges, to_undirected
from .propagate import propagate, weighted
from .reduce import degree, gcn_norm


def compose(df, *steps):
    """Apply table-to-table steps in turn."""
    return reduce(lambda d, f: f(d), steps, df)


# node features ------------------------------------------------------------------

def constant(nodes: DataFrame, value: float = 1.0, cat: bool = True) -> DataFrame:
    extra = F.array(F.lit(float(value)))
    return nodes.withColumn("x", F.concat("x", extra) if cat and "x" in nodes.columns else extra)


def normalize_features(nodes: DataFrame, dim: int) -> DataFrame:
    """x / max(sum(x), 1)"""
    xs = vec.parts("x", dim)
    return nodes.withColumn("x", vec.pack([c / F.greatest(vec.add_all(xs), F.lit(1.0)) for c in xs]))


def one_hot_degree(g: Graph, max_degree: int, in_degree: bool = False, cat: bool = True) -> DataFrame:
    """Append the one-hot degree; a degree above ``max_degree`` is an error, as published."""
    deg = degree(g.edges, g.nodes, "dst" if in_degree else "src")
    hot = F.transform(F.sequence(F.lit(0), F.lit(max_degree)),
                      lambda d: (F.col("deg") == d).cast("double"))
    guarded = F.when(F.col("deg") <= max_degree, hot).otherwise(
        F.raise_error(F.lit("degree above max_degree")))
    out = g.nodes.join(deg, "id")
    return out.withColumn("x", F.concat("x", guarded) if cat and "x" in out.columns else guarded).drop("deg")


def local_degree_profile(g: Graph) -> DataFrame:
    """(id, deg, min, max, mean, std) of neighbour degrees; sample std, 0 when undefined."""
    deg = degree(g.edges, g.nodes, "src")
    near = g.edges.join(deg.select(F.col("id").alias("dst"), "deg"), "dst")
    stats = near.groupBy(F.col("src").alias("id")).agg(
        F.min("deg").alias("min"), F.max("deg").alias("max"),
        F.avg("deg").alias("mean"), F.stddev_samp("deg").alias("std"))
    return deg.join(stats, "id", "left").na.fill(0.0, ["min", "max", "mean", "std"])


def target_indegree(g: Graph, norm: bool = True) -> DataFrame:
    """Edge attribute: in-degree of the target, over its maximum."""
    deg = degree(g.edges, g.nodes, "dst")
    out = g.edges.join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("attr")), "dst")
    if norm:
        out = out.crossJoin(F.broadcast(deg.agg(F.max("deg").alias("_m")))).withColumn(
            "attr", F.col("attr") / F.col("_m")).drop("_m")
    return out


def sign(g: Graph, k: int) -> DataFrame:
    """Nodes with x1..xk = successive symmetric-normalised propagations (no added loops)."""
    step = Graph(g.nodes, gcn_norm(g.edges, g.nodes, loops=False), g.dim)
    for hop in range(1, k + 1):
        cur = step.with_nodes(step.nodes.withColumn("_keep", F.col("x")).withColumn(
            "x", F.col(f"x{hop - 1}") if hop > 1 else F.col("x")))
        done = propagate(cur, weighted, "add", out=f"x{hop}")
        step = step.with_nodes(done.withColumn("x", F.col("_keep")).drop("_keep"))
    return step.nodes


# structure ------------------------------------------------------------------------

def two_hop(edges: DataFrame) -> DataFrame:
    """Edges plus every 2-hop pair with weight 0, merged with weights summed."""
    a = edges.select("src", F.col("dst").alias("mid")).distinct()
    b = edges.select(F.col("src").alias("mid"), "dst").distinct()
    far = a.join(b, "mid").filter("src <> dst").select("src", "dst", F.lit(0.0).alias("w"))
    return coalesce_edges(edges.select("src", "dst", "w").unionAll(far))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, e): edges in (src, dst) order with their ordinal."""
    return global_index(edges.select("src", "dst").distinct(), [F.col("src"), F.col("dst")], "e")


def line_graph_directed(edges: DataFrame) -> DataFrame:
    """Edge ordinals linked where one edge ends where the next begins."""
    n = cut(numbered_edges(edges))
    return n.select(F.col("e").alias("src"), F.col("dst").alias("mid")).join(
        n.select(F.col("src").alias("mid"), F.col("e").alias("dst")), "mid").select("src", "dst")


def line_graph_undirected(edges: DataFrame) -> DataFrame:
    """Upper-triangle edge ordinals linked where they share an end."""
    n = numbered_edges(edges.filter("src < dst"))
    ends = cut(n.select("e", F.explode(F.array("src", "dst")).alias("v")))
    return ends.join(ends.withColumnRenamed("e", "f"), "v").filter("e <> f").select(
        F.col("e").alias("src"), F.col("f").alias("dst")).distinct()


def face_to_edge(faces: DataFrame) -> DataFrame:
    """Triangles (a, b, c) to undirected edges."""
    sides = faces.select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("c").alias("dst")),
        F.struct(F.col("a").alias("src"), F.col("c").alias("dst")))).alias("e")).select("e.*")
    return to_undirected(sides)


def quads_to_triangles(faces: DataFrame) -> DataFrame:
    """(corners ARRAY of 3 or 4) to triangles a, b, c."""
    v = F.col("corners")
    tri = lambda i, j, k: F.struct(v[i].alias("a"), v[j].alias("b"), v[k].alias("c"))
    return faces.select(F.explode(F.when(F.size(v) == 4, F.array(tri(0, 1, 2), tri(0, 2, 3)))
                                  .otherwise(F.array(tri(0, 1, 2)))).alias("t")).select("t.*")


# positions: nodes(id, graph_id?, pos ARRAY) ------------------------------------------

def _with_stats(nodes: DataFrame, aggs: list[Column], by: str | None) -> DataFrame:
    stats = nodes.groupBy(*([by] if by else [])).agg(*aggs)
    return nodes.join(stats, by) if by else nodes.crossJoin(F.broadcast(stats))


def center(nodes: DataFrame, dim: int, by: str | None = None) -> DataFrame:
    ps = vec.parts("pos", dim)
    m = _with_stats(nodes, [F.array(*[F.avg(c) for c in ps]).alias("_mu")], by)
    return m.withColumn("pos", vec.pack([c - u for c, u in zip(ps, vec.parts("_mu", dim))])).drop("_mu")


def normalize_scale(nodes: DataFrame, dim: int, by: str | None = None) -> DataFrame:
    """Centre, then scale into (-1, 1)."""
    c = center(nodes, dim, by)
    ps = vec.parts("pos", dim)
    m = _with_stats(c, [F.max(F.greatest(*[F.abs(p) for p in ps])).alias("_m")], by)
    return m.withColumn("pos", vec.pack([p * (1 / F.col("_m")) * 0.999999 for p in ps])).drop("_m")


def normalize_rotation(nodes: DataFrame, dim: int, by: str = "graph_id") -> DataFrame:
    """Rotate each graph to its principal axes (largest variance first, axis sign fixed so
    its largest component is positive). Only the small second-moment matrix leaves Spark's
    aggregation: the eigenvectors of one dim x dim matrix per graph."""
    c = center(nodes, dim, by)
    ps = vec.parts("pos", dim)
    moments = c.groupBy(by).agg(F.array(*[F.sum(ps[a] * ps[b]) for a in range(dim)
                                          for b in range(dim)]).alias("s"))

    def axes(s: pd.Series) -> pd.Series:
        out = []
        for m in s:
            val, v = np.linalg.eigh(np.array(m).reshape(dim, dim))
            v = v[:, np.argsort(-val)]
            sign_ = np.sign(v[np.abs(v).argmax(axis=0), range(dim)])
            out.append((v * np.where(sign_ == 0, 1, sign_)).ravel())
        return pd.Series(out)

    turned = c.join(moments.select(by, F.pandas_udf(axes, "array<double>")("s").alias("_v")), by)
    v = vec.parts("_v", dim * dim)
    return turned.withColumn("pos", vec.pack([vec.add_all(
        [ps[a] * v[a * dim + b] for a in range(dim)]) for b in range(dim)])).drop("_v")


def linear_transformation(nodes: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """pos @ matrix^T"""
    turned = [[matrix[r][c] for r in range(len(matrix))] for c in range(len(matrix[0]))]
    return nodes.withColumn("pos", vec.pack(vec.linear(vec.parts("pos", len(turned)), turned)))


def _draw(nodes: DataFrame, low: float, high: float, seed: int) -> Column:
    """One uniform draw per graph."""
    key = F.col("graph_id") if "graph_id" in nodes.columns else F.lit(0)
    return mix.unit(key, seed=seed) * (high - low) + low


def random_flip(nodes: DataFrame, axis: int, dim: int, p: float = 0.5, seed: int = 0) -> DataFrame:
    flip = _draw(nodes, 0, 1, seed) < p
    ps = vec.parts("pos", dim)
    return nodes.withColumn("pos", vec.pack(
        [F.when(flip, -c).otherwise(c) if k == axis else c for k, c in enumerate(ps)]))


def random_rotate(nodes: DataFrame, degrees: float, axis: int, dim: int, seed: int = 0) -> DataFrame:
    a = _draw(nodes, -degrees, degrees, seed) * (math.pi / 180)
    s, c = F.sin(a), F.cos(a)
    p = vec.parts("pos", dim)
    if dim == 2:
        out = [c * p[0] + s * p[1], -s * p[0] + c * p[1]]
    else:
        u, v = [(1, 2), (0, 2), (0, 1)][axis]
        lead = -1 if axis == 1 else 1  # the middle axis turns the other way
        out = list(p)
        out[u] = c * p[u] + lead * s * p[v]
        out[v] = -lead * s * p[u] + c * p[v]
    return nodes.withColumn("pos", vec.pack(out))


def random_scale(nodes: DataFrame, low: float, high: float, dim: int, seed: int = 0) -> DataFrame:
    k = _draw(nodes, low, high, seed)
    return nodes.withColumn("pos", vec.pack([c * k for c in vec.parts("pos", dim)]))


def random_shear(nodes: DataFrame, shear: float, dim: int, seed: int = 0) -> DataFrame:
    p = vec.parts("pos", dim)
    return nodes.withColumn("pos", vec.pack([vec.add_all([
        p[b] if a == b else p[b] * _draw(nodes, -shear, shear, seed + a * dim + b)
        for b in range(dim)]) for a in range(dim)]))


def random_translate(nodes: DataFrame, amount: float, dim: int, seed: int = 0) -> DataFrame:
    """Jitter every node on its own."""
    return nodes.withColumn("pos", vec.pack([
        c + (mix.unit("id", seed=seed + k) * 2 - 1) * amount for k, c in enumerate(vec.parts("pos", dim))]))


def fixed_points(nodes: DataFrame, num: int, replace: bool = True, allow_duplicates: bool = False,
                 seed: int = 0, by: str = "graph_id") -> DataFrame:
    """Exactly ``num`` rows per graph (fewer only without replacement and duplicates)."""
    draw = mix.mix("id", seed=seed)
    if not replace and not allow_duplicates:
        return top_k(nodes.withColumn("_d", draw), [by], [F.col("_d"), F.col("id")], num, "_r").drop("_d", "_r")
    placed = cut(running(nodes.withColumn("_d", draw), [by], [F.col("_d"), F.col("id")],
                         {"_r": F.lit(1).cast("bigint")}))
    size = placed.groupBy(by).agg(F.count("*").alias("_n"))
    slots = size.select(by, "_n", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(num - 1).cast("bigint"))).alias("slot"))
    pick = mix.mix(by, "slot", seed=seed + 1) if replace else F.col("slot")  # else cycle
    slots = slots.select(by, "slot", (F.pmod(pick, F.col("_n")) + 1).alias("_r"))
    return slots.join(placed, [by, "_r"]).drop("_r", "_d")


# edge attributes from positions -------------------------------------------------------

def _delta(g: Graph) -> tuple[DataFrame, list[Column]]:
    """Edges with pos of both ends, and pos[dst] - pos[src]."""
    s = g.nodes.select(F.col("id").alias("src"), F.col("pos").alias("_ps"))
    d = g.nodes.select(F.col("id").alias("dst"), F.col("pos").alias("_pd"))
    e = g.edges.join(s, "src").join(d, "dst")
    return e, [b - a for a, b in zip(vec.parts("_ps", g.dim), vec.parts("_pd", g.dim))]


def _finish(e: DataFrame, g: Graph, attr: list[Column]) -> DataFrame:
    return e.select(*g.edges.columns, vec.pack(attr).alias("attr"))


def _over_max(e: DataFrame, size: Column) -> tuple[DataFrame, Column]:
    top = e.agg(F.max(size).alias("_m"))  # one row
    return e.crossJoin(F.broadcast(top)), F.col("_m")


def cartesian(g: Graph, norm: bool = True) -> DataFrame:
    e, d = _delta(g)
    if not norm:
        return _finish(e, g, d)
    e, m = _over_max(e, F.greatest(*[F.abs(c) for c in d]))
    return _finish(e, g, [c / (2 * m) + 0.5 for c in d])


def local_cartesian(g: Graph) -> DataFrame:
    """As ``cartesian`` with the maximum taken per source."""
    e, d = _delta(g)
    top = e.groupBy("src").agg(F.max(F.greatest(*[F.abs(c) for c in d])).alias("_m"))
    return _finish(e.join(top, "src"), g, [c / (2 * F.col("_m")) + 0.5 for c in d])


def distance(g: Graph, norm: bool = True) -> DataFrame:
    e, d = _delta(g)
    rho = vec.norm2(d)
    if norm:
        e, m = _over_max(e, rho)
        rho = rho / m
    return _finish(e, g, [rho])


def _azimuth(d: list[Column]) -> Column:
    t = F.atan2(d[1], d[0])
    return F.when(t < 0, t + 2 * math.pi).otherwise(t)


def polar(g: Graph, norm: bool = True) -> DataFrame:
    e, d = _delta(g)
    rho, theta = vec.norm2(d), _azimuth(d)
    if norm:
        e, m = _over_max(e, rho)
        rho, theta = rho / m, theta / (2 * math.pi)
    return _finish(e, g, [rho, theta])


def spherical(g: Graph, norm: bool = True) -> DataFrame:
    e, d = _delta(g)
    rho, theta = vec.norm2(d), _azimuth(d)
    phi = F.acos(d[2] / rho)
    if norm:
        e, m = _over_max(e, rho)
        rho, theta, phi = rho / m, theta / (2 * math.pi), phi / math.pi
    return _finish(e, g, [rho, theta, phi])


def ppf(pi: list[Column], pj: list[Column], ni: list[Column], nj: list[Column]) -> list[Column]:
    """|d| and the three angles (n_i, d), (n_j, d), (n_i, n_j)."""
    d = [b - a for a, b in zip(pi, pj)]
    return [vec.norm2(d), vec.angle(ni, d), vec.angle(nj, d), vec.angle(ni, nj)]


def point_pair_features(g: Graph) -> DataFrame:
    """Edge attribute from ``pos`` and ``normal`` of both ends."""
    s = g.nodes.select(F.col("id").alias("src"), F.col("pos").alias("_ps"), F.col("normal").alias("_ns"))
    d = g.nodes.select(F.col("id").alias("dst"), F.col("pos").alias("_pd"), F.col("normal").alias("_nd"))
    e = g.edges.join(s, "src").join(d, "dst")
    return _finish(e, g, ppf(*[vec.parts(c, 3) for c in ("_ps", "_pd", "_ns", "_nd")]))


# meshes ---------------------------------------------------------------------------------

def _corners(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for corner in "abc":
        out = out.join(nodes.select(F.col("id").alias(corner), F.col("pos").alias(f"_p{corner}")), corner)
    return out


def _sides() -> tuple[list[Column], list[Column], list[Column]]:
    a, b, c = (vec.parts(f"_p{k}", 3) for k in "abc")
    return a, [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]


def _unit(v: list[Column]) -> list[Column]:
    n = F.greatest(vec.norm2(v), F.lit(1e-12))
    return [c / n for c in v]


def mesh_normals(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    """Nodes with ``normal``: unit face normals summed at the corners, normalised."""
    _, u, v = _sides()
    f = _corners(nodes, faces).select("a", "b", "c", vec.pack(_unit(vec.cross(u, v))).alias("n"))
    at = f.select(F.explode(F.array("a", "b", "c")).alias("id"), "n").groupBy("id").agg(
        *[F.sum(c).alias(f"_n{k}") for k, c in enumerate(vec.parts("n", 3))])
    summed = [F.coalesce(f"_n{k}", F.lit(0.0)) for k in range(3)]
    return nodes.join(at, "id", "left").withColumn("normal", vec.pack(_unit(summed))).drop("_n0", "_n1", "_n2")


def sample_points(nodes: DataFrame, faces: DataFrame, num: int, seed: int = 0) -> DataFrame:
    """``num`` points on the mesh (face_id on ``faces``), faces drawn by area.

    Each draw lands in a cumulative-area interval; draws and intervals meet on a grid of
    equal-width area cells, so the range join is an equi-join plus a residual.
    """
    a, u, v = _sides()
    area = vec.norm2(vec.cross(u, v)) / 2
    f = _corners(nodes, faces).select("face_id", vec.pack(a).alias("p"), vec.pack(u).alias("u"),
                                      vec.pack(v).alias("v"), area.alias("area"))
    run = cut(running(f, [], [F.col("face_id")], {"hi": F.col("area")}))
    total, n = run.agg(F.max("hi"), F.count("*")).first()
    cells = max(1, int(n))
    cell = lambda c: F.least(F.floor(c / total * cells), F.lit(cells - 1))
    spans = run.withColumn("lo", F.col("hi") - F.col("area")).withColumn(
        "cell", F.explode(F.sequence(cell(F.greatest(F.col("lo"), F.lit(0.0))), cell(F.col("hi")))))
    draws = nodes.sparkSession.range(num).select(
        F.col("id").alias("sample"), (mix.unit("id", seed=seed) * total).alias("at"),
        mix.unit("id", seed=seed + 1).alias("s"), mix.unit("id", seed=seed + 2).alias("r"))
    hit = draws.withColumn("cell", cell(F.col("at"))).join(spans, "cell").filter(
        (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    fold = F.col("s") + F.col("r") > 1
    s, r = F.when(fold, 1 - F.col("s")).otherwise(F.col("s")), F.when(fold, 1 - F.col("r")).otherwise(F.col("r"))
    pos = [p + s * x + r * y for p, x, y in zip(*[vec.parts(c, 3) for c in "puv"])]
    normal = _unit(vec.cross(vec.parts("u", 3), vec.parts("v", 3)))
    return hit.select("sample", "face_id", vec.pack(pos).alias("pos"), vec.pack(normal).alias("normal"))


# diffusion --------------------------------------------------------------------------------

def transition(edges: DataFrame, how: str | None) -> DataFrame:
    """Normalise weights: "sym", "col" or "row"; zero sums give weight 0."""
    if how is None:
        return edges
    if how == "sym":
        return gcn_norm(edges, None, loops=False)
    key = "dst" if how == "col" else "src"
    s = edges.groupBy(key).agg(F.sum("w").alias("_s"))
    return edges.join(s, key).select("src", "dst", vec.ratio(F.col("w"), F.col("_s")).alias("w"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product of (src, dst, w) tables."""
    return a.select("src", F.col("dst").alias("_k"), F.col("w").alias("_a")).join(
        b.select(F.col("src").alias("_k"), "dst", F.col("w").alias("_b")), "_k").groupBy(
        "src", "dst").agg(F.sum(F.col("_a") * F.col("_b")).alias("w"))


def diffusion_powers(edges: DataFrame, nodes: DataFrame, coeffs: Sequence[float]) -> DataFrame:
    """sum_k coeffs[k] T^k as a sparse table."""
    edges = cut(edges.select("src", "dst", "w"))   # read by every power
    power = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    total = power.withColumn("w", F.col("w") * coeffs[0])
    for k, c in enumerate(coeffs[1:], 1):
        power = edges if k == 1 else matmul(power, edges)
        if 1 < k < len(coeffs) - 1:   # the last power is read once
            power = cut(power)
        total = total.unionAll(power.select("src", "dst", (F.col("w") * c).alias("w")))
    return coalesce_edges(total)


PUSH_PART = 256   # connected parts of up to this many nodes are pushed inside one task


def personalized_pagerank_push(edges: DataFrame, nodes: DataFrame, alpha: float, eps: float,
                               max_rounds: int = 200) -> DataFrame:
    """(src, dst, w): approximate personalised PageRank of every source by residual pushes.

    All pushes above the threshold ``alpha * eps * out_degree`` happen in one round;
    rounds go on until no residual is above it, so each source keeps at most 1/(alpha eps)
    mass-carrying entries. Raises if ``max_rounds`` rounds leave any above it.
    Small connected parts go through the same rounds inside a task, many to a task; larger ones in joined rounds.
    """
    from .settle import TASK_ROWS
    from .traverse import components
    step = cut(edges.select("src", "dst").filter("src is not null"))
    roots = cut(nodes.select("id").filter("id is not null"))
    ends = step.select("src").unionAll(step.filter("dst is not null").select("dst")).unionAll(roots).select(F.col("src").alias("id")).distinct()
    comp = components(both_ways(step.filter("src <> dst")), ends)
    sized = cut(comp.join(comp.groupBy("comp").agg(F.count("*").alias("n")), "comp").select("id", "comp", (F.col("n") <= PUSH_PART).alias("small")))
    rows = step.join(sized.select(F.col("id").alias("src"), "comp", "small"), "src").select("comp", "small", F.col("src").alias("a"), F.coalesce("dst", "src").alias("b"),
        F.when(F.col("dst").isNull(), 2).otherwise(1).alias("kind")).unionAll(
        roots.join(sized, "id").select("comp", "small", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0)))
    packs = max(2 * int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(step.count() + roots.count()) // TASK_ROWS))
    pack = F.pmod(F.xxhash64("comp"), F.lit(packs)).alias("pack")
    pushed = cut(rows.filter("small").select(pack, "comp", "a", "b", "kind").repartition(packs, "pack").groupBy("pack").applyInPandas(
        lambda pdf: _push_parts(pdf, alpha, eps, max_rounds), "src bigint, dst bigint, w double"))
    if pushed.filter("isnan(w) or w is null").limit(1).count():
        raise ValueError(f"residuals above the threshold after {max_rounds} rounds")
    large = sized.filter("not small")
    if large.limit(1).count():
        pushed = pushed.unionAll(_push_rounds(step.join(large.select(F.col("id").alias("src")), "src", "left_semi"),
                                              roots.join(large, "id", "left_semi"), alpha, eps, max_rounds))
    return pushed


def _push_parts(pdf: pd.DataFrame, alpha: float, eps: float, most: int) -> pd.DataFrame:
    """Rounds of whole connected parts, those of one size side by side; ``w`` is NaN where rounds did not suffice."""
    from .settle import _places
    comps, c = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
    kind, a, b = pdf["kind"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy()
    v, e, edge = kind == 0, kind == 1, kind > 0   # 2: an edge without target, counted in its source's degree only
    names, starts, (at, s, t, out) = _places(c[v], a[v], [(c[e], a[e]), (c[e], b[e]), (c[edge], a[edge])], len(comps))
    size, got = np.diff(starts), []
    for m in np.unique(size):
        every = np.flatnonzero(size == m)
        for which in np.array_split(every, -(-len(every) * int(m) ** 2 // 1_000_000)):
            here = np.full(len(comps), -1)
            here[which] = np.arange(len(which))
            link, deg, many = np.zeros((len(which), m, m)), np.zeros((len(which), m)), np.zeros((len(which), m))
            for x, places, into in ((here[c[e]], (s, t), link), (here[c[edge]], (out,), deg), (here[c[v]], (at,), many)):
                np.add.at(into, (x[x >= 0], *(k[x >= 0] for k in places)), 1)
            wall, each = (alpha * eps * deg)[:, None, :], np.maximum(deg, 1)[:, None, :]
            own = np.eye(m, dtype=bool)[None]
            p, r = np.zeros(link.shape), own * (alpha * many)[:, None, :]
            # roots that repeat start as rows of their own
            hot = own & (r > 0) & (deg > 0)[:, None, :] & (alpha > wall)
            for _ in range(most):
                if not hot.any():
                    break
                sent = np.where(hot, r, 0.0)
                p, r = p + sent, np.where(hot, 0.0, r) + ((1 - alpha) * sent / each) @ link
                hot = (deg > 0)[:, None, :] & (r > wall)
            k, i, j = np.nonzero(p > 0)
            first = starts[which][k]
            got.append(pd.DataFrame({"src": names[first + i], "dst": names[first + j], "w": np.full(len(k), np.nan) if hot.any() else p[k, i, j]}))
    return pd.concat(got) if got else pd.DataFrame({"src": [], "dst": [], "w": []})


def _push_rounds(step: DataFrame, roots: DataFrame, alpha: float, eps: float, max_rounds: int) -> DataFrame:
    deg = step.groupBy("src").agg(F.count("*").alias("d"))
    # targets come with their own degree, so no round looks up those of all rows
    out = cut(step.join(deg, "src").select(F.col("src").alias("at"), "dst", "d").join(
        deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst", "left"))
    s = cut(roots.join(deg.withColumnRenamed("src", "id"), "id", "left").select(
        F.col("id").alias("root"), F.col("id").alias("at"), F.lit(0.0).alias("p"), F.lit(alpha).alias("r"), "d"))
    hot = F.coalesce(F.col("r") > alpha * eps * F.col("d"), F.lit(False))
    for _ in range(max_rounds):
        if s.filter(hot).limit(1).count() == 0:
            break
        kept = s.select("root", "at", (F.col("p") + F.when(hot, F.col("r")).otherwise(0.0)).alias("p"),
                        F.when(hot, 0.0).otherwise(F.col("r")).alias("r"), "d")
        sent = s.filter(hot).select("root", "at", "r").join(out, "at").select(
            "root", F.col("dst").alias("at"), F.lit(0.0).alias("p"),
            ((1 - alpha) * F.col("r") / F.col("d")).alias("r"), F.col("dd").alias("d"))
        before = s
        s = cut(kept.unionAll(sent).groupBy("root", "at").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.max("d").alias("d")))
        release(before)
    else:
        if s.filter(hot).limit(1).count():
            raise ValueError(f"residuals above the threshold after {max_rounds} rounds")
    return s.filter("p > 0").select(F.col("root").alias("src"), F.col("at").alias("dst"), F.col("p").alias("w"))


def sparsify_threshold(edges: DataFrame, eps: float) -> DataFrame:
    return edges.filter(F.col("w") >= eps)


def sparsify_top_k(edges: DataFrame, k: int, by: str = "dst") -> DataFrame:
    other = "src" if by == "dst" else "dst"
    return top_k(edges, [by], [F.col("w").desc(), F.col(other)], k).drop("rank")


def threshold_for_degree(edges: DataFrame, nodes: DataFrame, avg_degree: int) -> float:
    """Midpoint between the (avg_degree * N)-th and the next largest weight.

    Two order statistics located by rank over a range layout; only those two rows return.
    """
    n = nodes.count()
    want = avg_degree * n
    ranked = global_index(edges.select("w", "src", "dst"), [F.col("w").desc(), F.col("src"), F.col("dst")], "_r")
    rows = ranked.filter(F.col("_r").isin(want - 1, want)).orderBy("_r").select("w").collect()  # two rows
    return sum(r[0] for r in rows) / len(rows) if len(rows) == 2 else float("-inf")


def gdc(edges: DataFrame, nodes: DataFrame, coeffs: Sequence[float], eps: float,
        self_loop: float = 1.0, norm_in: str = "sym", norm_out: str = "col") -> DataFrame:
    """Loops, normalise, diffuse by powers, drop weights under ``eps``, normalise again."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(self_loop).alias("w"))
    t = transition(coalesce_edges(edges.select("src", "dst", "w").unionAll(loops)), norm_in)
    return transition(sparsify_threshold(diffusion_powers(t, nodes, coeffs), eps), norm_out)


def largest_eigenvalue(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> float:
    """Power iteration on a symmetric (src, dst, w) operator until its value settles, or for ``rounds``; one scalar
    per round returns."""
    edges = cut(edges.select("src", "dst", "w"))   # read by every round
    x = nodes.select("id", (mix.unit("id", seed=1) + 0.5).alias("v"))
    value, last = 0.0, None
    for _ in itertools.count() if rounds is None else range(rounds):
        y = edges.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("w") * F.col("v")).alias("y"))
        y = cut(y)
        if last is not None:
            release(last)
        last = y
        size = math.sqrt(y.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0)
        if size == 0 or math.isnan(size) or abs(size - value) < 1e-9 * size:
            break
        value = size
        x = y.select("id", (F.col("y") / size).alias("v"))
    release(edges)
    if last is not None:
        release(last)
    return size if last is not None else value
