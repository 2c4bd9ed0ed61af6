"""Degrees, normalisations, readouts and norms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..core.session import cut
from ..core.ranges import top_k
from ..graph import Graph
from .edges import add_remaining_self_loops, remove_self_loops


def degree(edges: DataFrame, nodes: DataFrame, by: str = "src", weight: str | None = None,
           name: str = "deg") -> DataFrame:
    """(id, deg) with zeros for nodes that have none."""
    value = F.sum(weight) if weight else F.count("*")
    d = edges.groupBy(F.col(by).alias("id")).agg(value.cast("double").alias(name))
    return nodes.select("id").join(d, "id", "left").select(
        "id", F.coalesce(name, F.lit(0.0)).alias(name))


def with_degrees(edges: DataFrame, deg: DataFrame, on_src: str | None, on_dst: str | None) -> DataFrame:
    out = edges
    if on_src:
        out = out.join(deg.select(F.col("id").alias("src"), F.col("deg").alias(on_src)), "src")
    if on_dst:
        out = out.join(deg.select(F.col("id").alias("dst"), F.col("deg").alias(on_dst)), "dst")
    return out


def inv_sqrt(c: Column) -> Column:
    return F.when(c > 0, F.lit(1.0) / F.sqrt(c)).otherwise(0.0)


def inv(c: Column) -> Column:
    return F.when(c != 0, F.lit(1.0) / c).otherwise(0.0)


def gcn_norm(edges: DataFrame, nodes: DataFrame, loops: bool = True, improved: bool = False) -> DataFrame:
    """w / sqrt(D_src D_dst) with D summed over targets, after completing the loops."""
    e = edges.select("src", "dst", "w", *[c for c in ("e_id",) if c in edges.columns])
    if loops:
        e = add_remaining_self_loops(e, nodes, 2.0 if improved else 1.0)
    e = e.select("src", "dst", "w")
    d = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))
    # a source without incoming weight has D = 0 and so weight 0: keep it by left join
    src = d.select(F.col("id").alias("src"), F.col("deg").alias("_ds"))
    dst = d.select(F.col("id").alias("dst"), F.col("deg").alias("_dd"))
    return e.join(src, "src", "left").join(dst, "dst").select("src", "dst", (
        F.col("w") * inv_sqrt(F.coalesce("_ds", F.lit(0.0))) * inv_sqrt(F.col("_dd"))).alias("w"))


def get_laplacian(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """L = D - A, I - D^-1/2 A D^-1/2 ("sym") or I - D^-1 A ("rw"); D over sources."""
    e = remove_self_loops(edges).select("src", "dst", "w")
    deg = degree(e, nodes, "src", "w")
    if kind is None:
        off = e.withColumn("w", -F.col("w"))
        diag = deg.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("deg").alias("w"))
    else:
        if kind == "sym":
            off = with_degrees(e, deg, "_s", "_d").select("src", "dst", (
                -inv_sqrt(F.col("_s")) * F.col("w") * inv_sqrt(F.col("_d"))).alias("w"))
        else:
            off = with_degrees(e, deg, "_s", None).select(
                "src", "dst", (-inv(F.col("_s")) * F.col("w")).alias("w"))
        diag = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return off.unionByName(diag)


def normalized_cut(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """w (1/deg_src + 1/deg_dst), degrees counted at targets."""
    deg = degree(edges, nodes, "dst")
    return with_degrees(edges, deg, "_s", "_d").select("src", "dst", (
        F.col("w") * (inv(F.col("_s")) + inv(F.col("_d")))).alias("w"))


def homophily_ratio(edges: DataFrame, nodes: DataFrame, label: str = "y") -> DataFrame:
    s = nodes.select(F.col("id").alias("src"), F.col(label).alias("_ys"))
    d = nodes.select(F.col("id").alias("dst"), F.col(label).alias("_yd"))
    return edges.join(s, "src").join(d, "dst").agg(
        F.avg((F.col("_ys") == F.col("_yd")).cast("double")).alias("homophily"))


# readouts -------------------------------------------------------------------------

def global_pool(nodes: DataFrame, dim: int, how: str = "add", group: str = "graph_id") -> DataFrame:
    agg = {"add": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return nodes.groupBy(group).agg(vec.reduce_vec(agg, "x", dim).alias("x"))


def global_sort_pool(nodes: DataFrame, dim: int, k: int, group: str = "graph_id") -> DataFrame:
    """Top-k nodes by the last channel, flattened and zero-padded.

    Padding uses (global min - 1) turned into 0, so a genuine equal value would read 0 too.
    """
    order = [F.col("x")[dim - 1].desc(), F.col("id")]
    ranked = top_k(nodes, [group], order, k, "_r")
    rows = ranked.groupBy(group).agg(F.map_from_entries(  # at most k entries per graph
        F.collect_list(F.struct("_r", "x"))).alias("m"))
    blank = F.array(*[F.lit(0.0)] * dim)
    ranks = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    return rows.select(group, F.flatten(F.transform(
        ranks, lambda r: F.coalesce(F.try_element_at("m", r), blank))).alias("x"))


def global_attention(nodes: DataFrame, dim: int, gate: list[float], group: str = "graph_id") -> DataFrame:
    """Softmax-gated sum with a linear gate."""
    from .propagate import group_softmax
    g = vec.linear(vec.parts("x", dim), [[v] for v in gate])[0]
    soft = group_softmax(nodes.select(group, "x", g.alias("_g")), ["_g"], group)
    return soft.groupBy(group).agg(F.array(*[
        F.sum(F.col("_g") * c) for c in vec.parts("x", dim)]).alias("x"))


def set2set(nodes: DataFrame, dim: int, w_in: list[list[float]], w_state: list[list[float]], bias: list[float],
            steps: int, group: str = "graph_id") -> DataFrame:
    """(group, x) of width 2 dim: a recurrent query per graph reads the softmax-weighted sum of its nodes, ``steps`` times.

    Weights are rows by input channel, of 4 dim gates in the order input, forget, cell, output; ``w_in`` takes
    query and readout (2 dim), ``w_state`` the hidden state. One row of state per graph; a step is one
    aggregate over the nodes, so large graphs combine map-side.
    """
    from .propagate import group_softmax
    zero = F.array(*[F.lit(0.0)] * dim)
    state = cut(nodes.select(group).distinct().select(group, zero.alias("_h"), zero.alias("_c"), F.concat(zero, zero).alias("_q")))
    for _ in range(steps):
        gates = [a + b for a, b in zip(vec.linear(vec.parts("_q", 2 * dim), w_in, bias), vec.linear(vec.parts("_h", dim), w_state))]
        i, f, g, o = (gates[k * dim:(k + 1) * dim] for k in range(4))
        cell = [vec.sigmoid(f[k]) * F.col("_c")[k] + vec.sigmoid(i[k]) * F.tanh(g[k]) for k in range(dim)]
        state = state.select(group, vec.pack(cell).alias("_c"), vec.pack([vec.sigmoid(c) for c in o]).alias("_o"))
        state = cut(state.select(group, "_c", vec.pack([F.col("_o")[k] * F.tanh(F.col("_c")[k]) for k in range(dim)]).alias("_h")))
        asked = nodes.select(group, "x").join(state.select(group, "_h"), group)
        soft = group_softmax(asked.select(group, "x", vec.dot(vec.parts("x", dim), vec.parts("_h", dim)).alias("_e")), ["_e"], group)
        read = soft.groupBy(group).agg(F.array(*[F.sum(F.col("_e") * c) for c in vec.parts("x", dim)]).alias("_r"))
        state = cut(state.join(read, group).select(group, "_h", "_c", F.concat("_h", "_r").alias("_q")))
    return state.select(group, F.col("_q").alias("x"))


# norms ------------------------------------------------------------------------------

def _moments(nodes: DataFrame, dim: int, group: list[str], pooled: bool) -> DataFrame:
    """Mean and population variance per channel (or pooled over channels) per group.

    Two passes (mean, then mean squared gap), so large offsets do not cancel.
    """
    xs = vec.parts("x", dim)
    if pooled:
        mean = nodes.groupBy(*group).agg((F.sum(vec.add_all(xs)) / (F.count("*") * dim)).alias("_mu"))
        mus = [F.col("_mu")] * dim
    else:
        mean = nodes.groupBy(*group).agg(F.array(*[F.avg(c) for c in xs]).alias("_mu"))
        mus = vec.parts("_mu", dim)
    joined = nodes.join(mean, group) if group else nodes.crossJoin(F.broadcast(mean))
    sq = [(x - m) * (x - m) for x, m in zip(xs, mus)]
    if pooled:
        var = joined.groupBy(*group).agg((F.sum(vec.add_all(sq)) / (F.count("*") * dim)).alias("_var"))
    else:
        var = joined.groupBy(*group).agg(F.array(*[F.avg(c) for c in sq]).alias("_var"))
    return joined.join(var, group) if group else joined.crossJoin(F.broadcast(var))


def batch_norm(nodes: DataFrame, dim: int, eps: float = 1e-5) -> DataFrame:
    m = _moments(nodes, dim, [], False)
    out = [(x - u) / F.sqrt(v + eps) for x, u, v in zip(
        vec.parts("x", dim), vec.parts("_mu", dim), vec.parts("_var", dim))]
    return m.withColumn("x", vec.pack(out)).drop("_mu", "_var")


def instance_norm(nodes: DataFrame, dim: int, group: str = "graph_id", eps: float = 1e-5) -> DataFrame:
    m = _moments(nodes, dim, [group], False)
    out = [(x - u) / (F.sqrt(v) + eps) for x, u, v in zip(
        vec.parts("x", dim), vec.parts("_mu", dim), vec.parts("_var", dim))]
    return m.withColumn("x", vec.pack(out)).drop("_mu", "_var")


def layer_norm(nodes: DataFrame, dim: int, group: str | None = "graph_id", eps: float = 1e-5) -> DataFrame:
    m = _moments(nodes, dim, [group] if group else [], True)
    out = [(x - F.col("_mu")) / (F.sqrt("_var") + eps) for x in vec.parts("x", dim)]
    return m.withColumn("x", vec.pack(out)).drop("_mu", "_var")


def graph_size_norm(nodes: DataFrame, dim: int, group: str = "graph_id") -> DataFrame:
    n = nodes.groupBy(group).agg(F.count("*").alias("_n"))
    return nodes.join(n, group).withColumn("x", vec.pack(
        [c / F.sqrt(F.col("_n").cast("double")) for c in vec.parts("x", dim)])).drop("_n")


def pair_norm(nodes: DataFrame, dim: int, group: str = "graph_id", scale: float = 1.0,
              individually: bool = False, eps: float = 1e-5) -> DataFrame:
    xs = vec.parts("x", dim)
    mean = nodes.groupBy(group).agg(F.array(*[F.avg(c) for c in xs]).alias("_mu"))
    centred = nodes.join(mean, group).withColumn("x", vec.pack(
        [x - u for x, u in zip(xs, vec.parts("_mu", dim))])).drop("_mu")
    if individually:
        size = vec.norm2(xs) + eps
        return centred.withColumn("x", vec.pack([F.lit(scale) * x / size for x in xs]))
    power = centred.groupBy(group).agg(F.avg(vec.dot(xs, xs)).alias("_p"))
    return centred.join(power, group).withColumn("x", vec.pack(
        [F.lit(scale) * x / F.sqrt(F.lit(eps) + F.col("_p")) for x in xs])).drop("_p")


def message_norm(x: list[Column], m: list[Column], scale: float = 1.0) -> list[Column]:
    """scale * |x| * m / |m| (a zero message stays zero)."""
    size = F.greatest(vec.norm2(m), F.lit(1e-12))
    return [F.lit(scale) * vec.norm2(x) * c / size for c in m]
