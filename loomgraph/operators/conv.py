"""Message-passing layers with given weights, each a join, an edge expression and a reduce.

Weights are plain nested lists: rows by input channel, columns by output channel. Every
layer returns nodes with an ``out`` ARRAY<DOUBLE>. Where a linear map commutes with the
sum, it runs on the narrower side of the shuffle.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..core.session import cut
from ..graph import Graph
from .edges import add_self_loops, remove_self_loops
from .propagate import Side, attend, propagate, weighted
from .reduce import degree, gcn_norm, get_laplacian

Matrix = Sequence[Sequence[float]]
Cols = list[Column]


def feats(g: Graph, cols: Sequence[Column]) -> Graph:
    """Same graph with feature array replaced; the former one stays as ``_x``."""
    nodes = g.nodes if "_x" in g.nodes.columns else g.nodes.withColumn("_x", F.col("x"))
    return g.with_nodes(nodes.withColumn("x", vec.pack(cols)), len(cols))


def done(nodes: DataFrame, cols: Sequence[Column]) -> DataFrame:
    return nodes.select("id", vec.pack(cols).alias("out"))


def mapped(g: Graph, w: Matrix, b: Sequence[float] | None = None) -> Graph:
    return feats(g, vec.linear(vec.parts("x", g.dim), w, b))


def normalised(g: Graph, loops: bool = True, improved: bool = False) -> Graph:
    return g.with_edges(gcn_norm(g.edges, g.nodes, loops, improved))


def relooped(g: Graph) -> Graph:
    """Old loops out (weights lost), one loop per node in."""
    return g.with_edges(add_self_loops(remove_self_loops(g.edges), g.nodes))


def plus(a: Cols, b: Cols) -> Cols:
    return [x + y for x, y in zip(a, b)]


def scaled(a: Cols, k: float) -> Cols:
    return [c * F.lit(float(k)) for c in a]


def bias(a: Cols, b: Sequence[float] | None) -> Cols:
    return a if b is None else [c + F.lit(float(v)) for c, v in zip(a, b)]


def walk(g: Graph, steps: int, each: Callable[[Cols, Cols, Cols], Cols],
         keep: bool = False) -> tuple[DataFrame, list[str]]:
    """Iterate x <- each(propagated, x, x0); ``keep`` retains h0..hK columns.

    The plan grows by one join per step; it is cut every third step.
    """
    nodes = g.nodes.withColumn("h0", F.col("x"))
    names = ["h0"]
    for k in range(1, steps + 1):
        got = propagate(g.with_nodes(nodes), weighted, out="_p")
        nxt = each(vec.parts("_p", g.dim), vec.parts("x", g.dim), vec.parts("h0", g.dim))
        nodes = got.withColumn("x", vec.pack(nxt)).drop("_p")
        if keep:
            nodes = nodes.withColumn(f"h{k}", F.col("x"))
            names.append(f"h{k}")
        if k % 3 == 0 and k < steps:
            nodes = cut(nodes)
    return nodes, names


# spectral family -----------------------------------------------------------------

def gcn_conv(g: Graph, w: Matrix, b: Sequence[float] | None = None, improved: bool = False,
             loops: bool = True, normalize: bool = True) -> DataFrame:
    base = normalised(g, loops, improved) if normalize else g
    if len(w[0]) <= g.dim:
        got = propagate(mapped(base, w), weighted)
        return done(got, bias(vec.parts("out", len(w[0])), b))
    got = propagate(base, weighted)
    return done(got, vec.linear(vec.parts("out", g.dim), w, b))


def sg_conv(g: Graph, w: Matrix, k: int, b: Sequence[float] | None = None, loops: bool = True) -> DataFrame:
    nodes, _ = walk(normalised(g, loops), k, lambda p, x, x0: p)
    return done(nodes, vec.linear(vec.parts("x", g.dim), w, b))


def tag_conv(g: Graph, w: Matrix, k: int, b: Sequence[float] | None = None) -> DataFrame:
    """[x, Ax, .., A^k x] W, without added loops."""
    nodes, names = walk(normalised(g, loops=False), k, lambda p, x, x0: p, keep=True)
    return done(nodes, vec.linear([c for n in names for c in vec.parts(n, g.dim)], w, b))


def appnp(g: Graph, k: int, alpha: float, loops: bool = True) -> DataFrame:
    nodes, _ = walk(normalised(g, loops), k,
                    lambda p, x, x0: plus(scaled(p, 1 - alpha), scaled(x0, alpha)))
    return done(nodes, vec.parts("x", g.dim))


def gcn2_conv(g: Graph, w1: Matrix, alpha: float, beta: float = 1.0, w2: Matrix | None = None,
              x0: str = "x") -> DataFrame:
    """Initial residual and identity map; ``x0`` names the initial features."""
    got = propagate(normalised(g), weighted)
    h = scaled(vec.parts("out", g.dim), 1 - alpha)
    first = scaled(vec.parts(x0, g.dim), alpha)
    mix_ = lambda v, w: plus(scaled(v, 1 - beta), scaled(vec.linear(v, w), beta))
    if w2 is None:
        return done(got, mix_(plus(h, first), w1))
    return done(got, plus(mix_(h, w1), mix_(first, w2)))


def cheb_conv(g: Graph, weights: Sequence[Matrix], kind: str = "sym", lambda_max: float = 2.0,
              b: Sequence[float] | None = None) -> DataFrame:
    lap = get_laplacian(g.edges, g.nodes, kind)
    op = g.with_edges(add_self_loops(lap.withColumn("w", F.col("w") * 2.0 / lambda_max), g.nodes, -1.0))
    out = vec.linear(vec.parts("h0", g.dim), weights[0])
    nodes = op.nodes.withColumn("h0", F.col("x"))
    for k in range(1, len(weights)):
        got = propagate(op.with_nodes(nodes), weighted, out="_p")
        p = vec.parts("_p", g.dim)
        if k > 1:
            p = [2 * a - c for a, c in zip(p, vec.parts(f"h{k - 2}", g.dim))]
        nodes = got.withColumn(f"h{k}", vec.pack(p)).withColumn("x", F.col(f"h{k}")).drop("_p")
        out = plus(out, vec.linear(vec.parts(f"h{k}", g.dim), weights[k]))
        if k % 3 == 0:
            nodes = cut(nodes)
    return done(nodes, bias(out, b))


def arma_conv(g: Graph, init: Sequence[Matrix], inner: Sequence[Sequence[Matrix]],
              root: Sequence[Sequence[Matrix]], layers: int) -> DataFrame:
    """``init[stack]``, ``inner[layer][stack]``, ``root[layer][stack]``; relu, mean of stacks."""
    base = normalised(g, loops=False)
    nodes = base.nodes.withColumn("_x0", F.col("x"))
    stacks, width = len(init), len(init[0][0])
    for s in range(stacks):
        nodes = nodes.withColumn(f"_s{s}", F.col("x"))
    for t in range(layers):
        for s in range(stacks):
            w = init[s] if t == 0 else inner[min(t - 1, len(inner) - 1)][s]
            dim = g.dim if t == 0 else width
            cur = nodes.withColumn("x", vec.pack(vec.linear(vec.parts(f"_s{s}", dim), w)))
            got = propagate(Graph(cur, base.edges, width), weighted, out="_p")
            r = root[min(t, len(root) - 1)][s]
            nxt = plus(vec.parts("_p", width), vec.linear(vec.parts("_x0", g.dim), r))
            nodes = got.withColumn(f"_s{s}", vec.pack([vec.relu(c) for c in nxt])).drop("_p")
    return done(nodes, [vec.add_all([F.col(f"_s{s}")[c] for s in range(stacks)]) / stacks
                        for c in range(width)])


def cluster_gcn_conv(g: Graph, w_out: Matrix, w_root: Matrix, diag_lambda: float = 0.0,
                     b: Sequence[float] | None = None) -> DataFrame:
    """Weights 1/max(deg_in, 1); each loop gains diag_lambda / deg."""
    e = add_self_loops(remove_self_loops(g.edges), g.nodes).select("src", "dst")
    d = e.groupBy("dst").agg(F.greatest(F.count("*"), F.lit(1)).alias("_d"))
    w = e.join(d, "dst").select("src", "dst", (
        F.when(F.col("src") == F.col("dst"), 1 + diag_lambda).otherwise(1.0) / F.col("_d")).alias("w"))
    got = propagate(g.with_edges(w), weighted)
    return done(got, bias(plus(vec.linear(vec.parts("out", g.dim), w_out),
                               vec.linear(vec.parts("x", g.dim), w_root)), b))


# neighbour aggregation family -------------------------------------------------------

def graph_conv(g: Graph, w_rel: Matrix, w_root: Matrix, b: Sequence[float] | None = None,
               aggr: str = "add") -> DataFrame:
    got = propagate(g, weighted, aggr)
    return done(got, plus(vec.linear(vec.parts("out", g.dim), w_rel, b),
                          vec.linear(vec.parts("x", g.dim), w_root)))


def sage_conv(g: Graph, w_l: Matrix, w_r: Matrix, b: Sequence[float] | None = None,
              normalize: bool = False) -> DataFrame:
    got = propagate(g, None, "mean")
    out = plus(vec.linear(vec.parts("out", g.dim), w_l, b), vec.linear(vec.parts("x", g.dim), w_r))
    if normalize:
        size = F.greatest(vec.norm2(out), F.lit(1e-12))
        out = [c / size for c in out]
    return done(got, out)


def gin_conv(g: Graph, mlp: Callable[[Cols], Cols], eps: float = 0.0) -> DataFrame:
    got = propagate(g)
    return done(got, mlp(plus(vec.parts("out", g.dim), scaled(vec.parts("x", g.dim), 1 + eps))))


def gine_conv(g: Graph, attr: Cols, mlp: Callable[[Cols], Cols], eps: float = 0.0) -> DataFrame:
    got = propagate(g, lambda j, i: [vec.relu(c) for c in plus(j.vec(), attr)])
    return done(got, mlp(plus(vec.parts("out", g.dim), scaled(vec.parts("x", g.dim), 1 + eps))))


def le_conv(g: Graph, w1: Matrix, w2: Matrix, w3: Matrix) -> DataFrame:
    """sum_j w (W1 x_i - W2 x_j) + W3 x_i"""
    def message(j: Side, i: Side) -> Cols:
        a, b_ = vec.linear(i.vec(), w1), vec.linear(j.vec(), w2)
        return [F.col("w") * (p - q) for p, q in zip(a, b_)]
    got = propagate(g, message)
    return done(got, plus(vec.parts("out", len(w1[0])), vec.linear(vec.parts("x", g.dim), w3)))


def mf_conv(g: Graph, w_l: Sequence[Matrix], w_r: Sequence[Matrix]) -> DataFrame:
    """Weight pair picked by min(in-degree, max degree)."""
    got = propagate(g).join(degree(g.edges, g.nodes, "dst"), "id")
    d = F.least(F.col("deg"), F.lit(len(w_l) - 1))
    h, x = vec.parts("out", g.dim), vec.parts("x", g.dim)
    options = [plus(vec.linear(h, l), vec.linear(x, r)) for l, r in zip(w_l, w_r)]
    out = []
    for c in range(len(options[0])):
        pick = F.when(d == 0, options[0][c])
        for k in range(1, len(options)):
            pick = pick.when(d == k, options[k][c])
        out.append(pick)
    return done(got, out)


def edge_conv(g: Graph, h: Callable[[Cols], Cols], aggr: str = "max") -> DataFrame:
    """Aggregate h([x_i, x_j - x_i])."""
    def message(j: Side, i: Side) -> Cols:
        xi, xj = i.vec(), j.vec()
        return h(xi + [b_ - a for a, b_ in zip(xi, xj)])
    return propagate(g, message, aggr).select("id", "out")


def cg_conv(g: Graph, w_f: Matrix, w_s: Matrix, attr: Cols = ()) -> DataFrame:
    """x_i + sum sigmoid(z Wf) softplus(z Ws), z = [x_i, x_j, attr]"""
    def message(j: Side, i: Side) -> Cols:
        z = i.vec() + j.vec() + list(attr)
        return [vec.sigmoid(a) * vec.softplus(b_) for a, b_ in zip(vec.linear(z, w_f), vec.linear(z, w_s))]
    got = propagate(g, message)
    return done(got, plus(vec.parts("out", g.dim), vec.parts("x", g.dim)))


def gen_conv(g: Graph, aggr: str = "softmax", t: float = 1.0, p: float = 1.0, eps: float = 1e-7,
             mlp: Callable[[Cols], Cols] = lambda v: v) -> DataFrame:
    """Messages relu(x_j) + eps; softmax- or power-mean, plus the node's own features."""
    source = g.nodes.select(F.col("id").alias("src"), "x")
    e = g.edges.select("src", "dst").join(source, "src")
    m = [vec.relu(c) + eps for c in vec.parts("x", g.dim)]
    e = e.select("dst", *[c.alias(f"m{k}") for k, c in enumerate(m)])
    names = [f"m{k}" for k in range(g.dim)]
    if aggr.startswith("softmax"):
        top = e.agg(*[F.max(F.col(n) * t).alias(f"_t{n}") for n in names])  # one row
        e = e.crossJoin(F.broadcast(top))
        ex = {n: F.exp(F.col(n) * t - F.col(f"_t{n}")) for n in names}
        s = e.groupBy(F.col("dst").alias("id")).agg(*[
            (F.sum(ex[n] * F.col(n)) / (F.sum(ex[n]) + 1e-16)).alias(n) for n in names])
    else:
        clip = lambda c: F.least(F.greatest(c, F.lit(1e-7)), F.lit(10.0))
        s = e.groupBy(F.col("dst").alias("id")).agg(*[
            F.pow(clip(F.avg(F.pow(clip(F.col(n)), p))), 1 / p).alias(n) for n in names])
    # a node without messages has mean 0, which the power mean lifts to its lower clip
    empty = 0.0 if aggr.startswith("softmax") else (1e-7) ** (1 / p)
    got = g.nodes.join(s, "id", "left")
    return done(got, mlp(plus([F.coalesce(n, F.lit(empty)) for n in names], vec.parts("x", g.dim))))


def pna_conv(g: Graph, aggregators: Sequence[str], scalers: Sequence[str]) -> DataFrame:
    """Aggregator block scaled step by step; every scaler multiplies the already scaled block."""
    e = g.edges.select("src", "dst").join(g.nodes.select(F.col("id").alias("src"), "x"), "src")
    xs = vec.parts("x", g.dim)
    s = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"), *[a for k, c in enumerate(xs) for a in (
        F.sum(c).alias(f"s{k}"), F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}"), F.sum(c * c).alias(f"q{k}"))])
    # average degrees over all nodes, from the aggregate just made
    got = g.nodes.select("id").join(s, "id", "left").na.fill(0)
    d = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    stats = got.agg(F.avg("_n").alias("_lin"), F.avg(F.log(F.col("_n") + 1.0)).alias("_log"))  # one row
    got = got.crossJoin(F.broadcast(stats))

    def block(a: str) -> Cols:
        out = []
        for k in range(g.dim):
            mean = F.col(f"s{k}") / d
            var = F.col(f"q{k}") / d - mean * mean
            out.append({"sum": F.col(f"s{k}"), "mean": mean, "min": F.col(f"lo{k}"), "max": F.col(f"hi{k}"),
                        "var": var, "std": F.sqrt(vec.relu(var) + 1e-5)}[a])
        return out

    cur = [c for a in aggregators for c in block(a)]
    factor = {"identity": F.lit(1.0), "amplification": F.log(d + 1) / F.col("_log"),
              "attenuation": F.col("_log") / F.log(d + 1), "linear": d / F.col("_lin"),
              "inverse_linear": F.col("_lin") / d}
    outs: Cols = []
    for name in scalers:
        cur = [c * factor[name] for c in cur]
        outs += cur
    return done(got, outs)


# attention family ---------------------------------------------------------------------

def agnn_conv(g: Graph, beta: float = 1.0) -> DataFrame:
    base = relooped(g)
    def unit(s: Side) -> Cols:
        n = F.greatest(vec.norm2(s.vec()), F.lit(1e-12))
        return [c / n for c in s.vec()]
    return attend(base, lambda j, i: [vec.dot(unit(i), unit(j)) * beta],
                  lambda j, i: [j.vec()]).select("id", "out")


def gat_conv(g: Graph, heads: Sequence[Matrix], att_src: Matrix, att_dst: Matrix,
             slope: float = 0.2, b: Sequence[float] | None = None, concat: bool = True) -> DataFrame:
    """Scores and mapped features are made once per node, before the edge joins."""
    width = len(heads[0][0])
    vals = [vec.linear(vec.parts("x", g.dim), w) for w in heads]
    left = [vec.dot(v, [F.lit(float(k)) for k in a]) for v, a in zip(vals, att_src)]
    right = [vec.dot(v, [F.lit(float(k)) for k in a]) for v, a in zip(vals, att_dst)]
    nodes = g.nodes.select("id", vec.pack([c for v in vals for c in v]).alias("x"),
                           vec.pack(left).alias("al"), vec.pack(right).alias("ar"))
    base = relooped(Graph(nodes, g.edges, width * len(heads)))
    got = attend(base, lambda j, i: [vec.leaky(j["al"][h] + i["ar"][h], slope) for h in range(len(heads))],
                 lambda j, i: [j.vec()[h * width:(h + 1) * width] for h in range(len(heads))])
    out = vec.parts("out", width * len(heads))
    if not concat:
        out = [vec.add_all(out[c::width]) / len(heads) for c in range(width)]
    return done(got, bias(out, b))


def transformer_conv(g: Graph, wq: Matrix, wk: Matrix, wv: Matrix, w_skip: Matrix | None = None,
                     edge: Cols | None = None, beta: Sequence[float] | None = None) -> DataFrame:
    """One head of q.k / sqrt(C) attention; ``edge`` (already mapped) joins key and value."""
    width = len(wq[0])
    x = vec.parts("x", g.dim)
    nodes = g.nodes.select("*", vec.pack(vec.linear(x, wq)).alias("q"),
                           vec.pack(vec.linear(x, wk)).alias("k"), vec.pack(vec.linear(x, wv)).alias("v"))
    extra = edge or [F.lit(0.0)] * width
    got = attend(g.with_nodes(nodes),
                 lambda j, i: [vec.dot(i.vec("q", width), plus(j.vec("k", width), extra)) / math.sqrt(width)],
                 lambda j, i: [plus(j.vec("v", width), extra)])
    out = vec.parts("out", width)
    if w_skip is not None:
        r = vec.linear(x, w_skip)
        if beta is None:
            out = plus(out, r)
        else:
            gate = vec.sigmoid(vec.dot(out + r + [a - c for a, c in zip(out, r)], [F.lit(float(v)) for v in beta]))
            out = [gate * c + (1 - gate) * a for a, c in zip(out, r)]
    return done(got, out)


def feast_conv(g: Graph, heads: Sequence[Matrix], u: Matrix, c: Sequence[float],
               b: Sequence[float] | None = None) -> DataFrame:
    """Per edge a softmax over heads of u (x_j - x_i) + c, mean over edges."""
    def message(j: Side, i: Side) -> Cols:
        q = [F.exp(v) for v in vec.linear([a - d for a, d in zip(j.vec(), i.vec())], u, c)]
        total = vec.add_all(q)
        return [vec.add_all([q[h] / total * vec.linear(j.vec(), w)[o] for h, w in enumerate(heads)])
                for o in range(len(heads[0][0]))]
    got = propagate(relooped(g), message, "mean")
    return done(got, bias(vec.parts("out", len(heads[0][0])), b))


# typed edges -------------------------------------------------------------------------------

def rgcn_conv(g: Graph, weights: Sequence[Matrix], root: Matrix | None = None, etype: str = "etype",
              aggr: str = "mean", b: Sequence[float] | None = None) -> DataFrame:
    """Reduce per (target, relation) once, then map each relation's slice: one shuffle for all."""
    e = g.edges.join(g.nodes.select(F.col("id").alias("src"), "x"), "src")
    agg = {"mean": F.avg, "add": F.sum, "max": F.max}[aggr]
    per = e.groupBy(F.col("dst").alias("id"), etype).agg(*[agg(c).alias(f"m{k}") for k, c in enumerate(vec.parts("x", g.dim))])
    ms = [F.col(f"m{k}") for k in range(g.dim)]
    width = len(weights[0][0])
    def pick(o: int) -> Column:
        col = F.when(F.col(etype) == 0, vec.linear(ms, weights[0])[o])
        for r in range(1, len(weights)):
            col = col.when(F.col(etype) == r, vec.linear(ms, weights[r])[o])
        return col.otherwise(0.0)
    summed = per.groupBy("id").agg(*[F.sum(pick(o)).alias(f"o{o}") for o in range(width)])
    got = g.nodes.join(summed, "id", "left")
    out = [F.coalesce(f"o{o}", F.lit(0.0)) for o in range(width)]
    if root is not None:
        out = plus(out, vec.linear(vec.parts("x", g.dim), root))
    return done(got, bias(out, b))


def basis_weights(comp: Matrix, bases: Sequence[Matrix]) -> list[list[list[float]]]:
    """Relation weights as combinations of shared bases."""
    return [[[sum(c * m[r][o] for c, m in zip(row, bases)) for o in range(len(bases[0][0]))]
             for r in range(len(bases[0]))] for row in comp]


def block_weights(blocks: Sequence[Sequence[Matrix]]) -> list[list[list[float]]]:
    """Block-diagonal relation weights."""
    out = []
    for rel in blocks:
        rows, cols = sum(len(m) for m in rel), sum(len(m[0]) for m in rel)
        w = [[0.0] * cols for _ in range(rows)]
        r0 = c0 = 0
        for m in rel:
            for r, line in enumerate(m):
                w[r0 + r][c0:c0 + len(line)] = line
            r0, c0 = r0 + len(m), c0 + len(m[0])
        out.append(w)
    return out


def film_conv(g: Graph, skip: Matrix, film_skip: Matrix, lins: Sequence[Matrix],
              films: Sequence[Matrix], etype: str = "etype", aggr: str = "mean") -> DataFrame:
    """relu(gamma_i * W x_j + beta_i) per relation, beta then gamma from the target's features."""
    x = vec.parts("x", g.dim)
    width = len(skip[0])
    def film(v: Cols, m: Matrix, h: Cols) -> Cols:
        bg = vec.linear(v, m)
        return [vec.relu(ga * c + be) for be, ga, c in zip(bg[:width], bg[width:], h)]
    nodes = g.nodes.withColumn("_acc", vec.pack(film(x, film_skip, vec.linear(x, skip))))
    for r, (lin, fm) in enumerate(zip(lins, films)):
        only = g.edges.filter(F.col(etype) == r) if len(lins) > 1 else g.edges
        got = propagate(Graph(nodes, only, g.dim),
                        lambda j, i: film(i.vec(), fm, vec.linear(j.vec(), lin)), aggr, out="_o")
        nodes = got.withColumn("_acc", vec.pack(plus(vec.parts("_acc", width), vec.parts("_o", width)))).drop("_o")
    return done(nodes, vec.parts("_acc", width))


def signed_conv(g: Graph, pos: DataFrame, neg: DataFrame, pos_l: Matrix, pos_r: Matrix,
                neg_l: Matrix, neg_r: Matrix, first: bool = True) -> DataFrame:
    """Separate means over positive and negative edges; later layers cross the two halves."""
    def mean(edges: DataFrame, name: str, nodes: DataFrame, lo: int, hi: int) -> DataFrame:
        return propagate(Graph(nodes, edges, g.dim), lambda j, i: j.vec()[lo:hi], "mean", out=name)
    x = vec.parts("x", g.dim)
    if first:
        nodes = mean(neg, "_n", mean(pos, "_p", g.nodes, 0, g.dim), 0, g.dim)
        p = plus(vec.linear(vec.parts("_p", g.dim), pos_l), vec.linear(x, pos_r))
        n = plus(vec.linear(vec.parts("_n", g.dim), neg_l), vec.linear(x, neg_r))
        return done(nodes, p + n)
    h = g.dim // 2
    nodes = mean(neg, "_nb", mean(pos, "_pb", mean(neg, "_na", mean(pos, "_pa", g.nodes, 0, h), 0, h), h, g.dim), h, g.dim)
    p = plus(vec.linear(vec.parts("_pa", h) + vec.parts("_nb", h), pos_l), vec.linear(x[:h], pos_r))
    n = plus(vec.linear(vec.parts("_pb", h) + vec.parts("_na", h), neg_l), vec.linear(x[h:], neg_r))
    return done(nodes, p + n)


# edge-conditioned and geometric -----------------------------------------------------------

def nn_conv(g: Graph, edge_weight: Callable[[], list[Cols]], root: Matrix | None = None,
            aggr: str = "add") -> DataFrame:
    """x_j @ M(e), the matrix columns being expressions over the edge's attributes."""
    def message(j: Side, i: Side) -> Cols:
        m = edge_weight()
        return [vec.add_all([x * m[r][c] for r, x in enumerate(j.vec())]) for c in range(len(m[0]))]
    got = propagate(g, message, aggr)
    width = vec_width(got)
    out = vec.parts("out", width)
    return done(got, plus(out, vec.linear(vec.parts("x", g.dim), root)) if root else out)


def vec_width(df: DataFrame) -> int:
    return vec.width(df, "out")


def gmm_conv(g: Graph, pseudo: Cols, weight: Sequence[Matrix], mu: Matrix, sigma: Matrix,
             root: Matrix | None = None, aggr: str = "mean") -> DataFrame:
    """Kernel k maps x_j by weight[k] with a Gaussian weight of the pseudo-coordinates."""
    width = len(weight[0][0])
    def message(j: Side, i: Side) -> Cols:
        out = [F.lit(0.0)] * width
        for w, m, s in zip(weight, mu, sigma):
            e = F.exp(vec.add_all([-0.5 * (p - a) * (p - a) / (1e-15 + b_ * b_) for p, a, b_ in zip(pseudo, m, s)]))
            out = plus(out, [e * c for c in vec.linear(j.vec(), w)])
        return out
    got = propagate(g, message, aggr)
    out = vec.parts("out", width)
    return done(got, plus(out, vec.linear(vec.parts("x", g.dim), root)) if root else out)


def spline_conv(g: Graph, pseudo: Cols, kernel: Sequence[int], weight: Sequence[Matrix],
                root: Matrix | None = None, aggr: str = "mean") -> DataFrame:
    """Open B-splines of degree 1: each edge mixes the 2^D kernel cells around its pseudo-
    coordinate. The edge explodes into its active cells and meets the weight rows by join."""
    dims, width = len(kernel), len(weight[0][0])
    e = g.edges.withColumns({f"_p{d}": c * (kernel[d] - 1) for d, c in enumerate(pseudo)})
    cells = []
    for corner in range(1 << dims):
        idx, basis, stride = F.lit(0), F.lit(1.0), 1
        for d in range(dims):
            p, up = F.col(f"_p{d}"), (corner >> d) & 1
            low = F.floor(p)
            idx = idx + F.pmod(low + up, F.lit(kernel[d])) * stride
            basis = basis * ((p - low) if up else (1 - (p - low)))
            stride *= kernel[d]
        cells.append(F.struct(idx.cast("int").alias("cell"), basis.alias("basis")))
    spread = e.select("src", "dst", F.explode(F.array(*cells)).alias("c")).select(
        "src", "dst", "c.cell", "c.basis").filter("basis <> 0")
    xs = g.nodes.select(F.col("id").alias("src"), "x")
    per = spread.groupBy("dst", "src", "cell").agg(F.sum("basis").alias("basis")).join(xs, "src")
    # sum over (cell) first: one small vector per (dst, cell), then the cell's matrix
    cell_sum = per.groupBy("dst", "cell").agg(*[F.sum(F.col("basis") * c).alias(f"m{k}") for k, c in enumerate(vec.parts("x", g.dim))])
    spark = g.nodes.sparkSession
    flat = spark.createDataFrame([(k, [float(v) for r in w for v in r]) for k, w in enumerate(weight)],
                                 "cell int, wt array<double>")  # one row per kernel cell
    out = [vec.add_all([F.col(f"m{r}") * F.col("wt")[r * width + c] for r in range(g.dim)]) for c in range(width)]
    summed = cell_sum.join(F.broadcast(flat), "cell").groupBy(F.col("dst").alias("id")).agg(
        *[F.sum(c).alias(f"o{k}") for k, c in enumerate(out)])
    got = g.nodes.join(summed, "id", "left")
    if aggr == "mean":
        got = got.join(degree(g.edges, g.nodes, "dst"), "id")
        outs = [F.coalesce(F.col(f"o{k}") / F.greatest("deg", F.lit(1.0)), F.lit(0.0)) for k in range(width)]
    else:
        outs = [F.coalesce(f"o{k}", F.lit(0.0)) for k in range(width)]
    return done(got, plus(outs, vec.linear(vec.parts("x", g.dim), root)) if root else outs)


def point_conv(g: Graph, pos_dim: int, local: Callable[[Cols], Cols] = lambda v: v) -> DataFrame:
    """max_j h([x_j, pos_j - pos_i]), loops renewed."""
    return propagate(relooped(g), lambda j, i: local(j.vec() + [
        a - b_ for a, b_ in zip(j.vec("pos", pos_dim), i.vec("pos", pos_dim))]), "max").select("id", "out")


def ppf_conv(g: Graph, local: Callable[[Cols], Cols] = lambda v: v) -> DataFrame:
    """max_j h([x_j, point-pair features(i, j)]), loops renewed."""
    from .transforms import ppf
    return propagate(relooped(g), lambda j, i: local(j.vec() + ppf(
        i.vec("pos", 3), j.vec("pos", 3), i.vec("normal", 3), j.vec("normal", 3))), "max").select("id", "out")


def gravnet_conv(g: Graph, knn_edges: DataFrame, w_h: Matrix, w_out: Matrix) -> DataFrame:
    """Mean and max of exp(-10 d^2) h_j over given nearest pairs (src, dst, d2), then a map of
    [mean, max, x]."""
    width = len(w_h[0])
    nodes = g.nodes.withColumn("h", vec.pack(vec.linear(vec.parts("x", g.dim), w_h)))
    base = Graph(nodes, knn_edges.withColumn("w", F.exp(-10.0 * F.col("d2"))), g.dim)
    msg = lambda j, i: [F.col("w") * c for c in j.vec("h", width)]
    mean = propagate(base, msg, "mean", out="_mean")
    both = propagate(base.with_nodes(mean), msg, "max", out="_max")
    return done(both, vec.linear(vec.parts("_mean", width) + vec.parts("_max", width) + vec.parts("x", g.dim), w_out))


def x_conv(nodes: DataFrame, pairs: DataFrame, k: int, pos_dim: int, dim: int, lift: Matrix,
           transform: Matrix, conv: Matrix) -> DataFrame:
    """Chi-transform over k ranked neighbours: (dst, src, rank) pairs with rank 0..k-1.

    Relative positions lift to features, a k x k matrix made from all relative positions
    re-weights the neighbours, and ``conv`` maps the k stacked feature rows.
    """
    s = nodes.select(F.col("id").alias("src"), F.col("pos").alias("_pj"), F.col("x").alias("_xj"))
    d = nodes.select(F.col("id").alias("dst"), F.col("pos").alias("_pi"))
    e = pairs.join(s, "src").join(d, "dst")
    rel = [a - b_ for a, b_ in zip(vec.parts("_pj", pos_dim), vec.parts("_pi", pos_dim))]
    elu = lambda c: F.when(c > 0, c).otherwise(F.exp(c) - 1)
    feat = [elu(c) for c in vec.linear(rel, lift)] + vec.parts("_xj", dim)
    # k rows per node, placed by rank: an aggregate of bounded width
    slot = lambda c, r: F.sum(F.when(F.col("rank") == r, c).otherwise(0.0))
    width = len(lift[0]) + dim
    row = e.groupBy(F.col("dst").alias("id")).agg(
        F.array(*[slot(c, r) for r in range(k) for c in rel]).alias("_rel"),
        F.array(*[slot(c, r) for r in range(k) for c in feat]).alias("_f"))
    chi = [elu(c) for c in vec.linear(vec.parts("_rel", k * pos_dim), transform)]
    f = vec.parts("_f", k * width)
    mixed = [vec.add_all([chi[a * k + b_] * f[b_ * width + c] for b_ in range(k)]) for a in range(k) for c in range(width)]
    return done(row, vec.linear(mixed, conv))


# hypergraph, colour refinement, gates --------------------------------------------------------

def hypergraph_conv(nodes: DataFrame, incidence: DataFrame, dim: int, w: Matrix,
                    b: Sequence[float] | None = None) -> DataFrame:
    """D^-1 H W B^-1 H^T x over incidence(node, hyperedge[, hw]); two join-sums, no pair blow-up."""
    x = nodes.select(F.col("id").alias("node"), *[c.alias(f"m{k}") for k, c in enumerate(
        vec.linear(vec.parts("x", dim), w))])
    width = len(w[0])
    inc = incidence if "hw" in incidence.columns else incidence.withColumn("hw", F.lit(1.0))
    names = [f"m{k}" for k in range(width)]
    edge = inc.join(x, "node").groupBy("hyperedge").agg(
        *[(F.sum(n) / F.count("*") * F.max("hw")).alias(n) for n in names])
    back = inc.join(edge, "hyperedge").groupBy(F.col("node").alias("id")).agg(
        *[vec.ratio(F.sum(n), F.sum("hw")).alias(n) for n in names])
    got = nodes.join(back, "id", "left")
    return done(got, bias([F.coalesce(n, F.lit(0.0)) for n in names], b))


def wl_conv(nodes: DataFrame, edges: DataFrame, color: str = "color") -> DataFrame:
    """One colour refinement: nodes alike in own colour and in-neighbour colour multiset get one
    colour, named by the smallest id among them.

    The multiset is compared by its size and two seeded 64-bit sums, so it is a map-side
    aggregate: a hub's neighbours are never gathered in one list.
    """
    def term(salt: int) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), color).cast("decimal(38,0)"))
    seen = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src"), color), "src").groupBy(
        F.col("dst").alias("id")).agg(F.count("*").alias("_n"), term(11).alias("_a"), term(29).alias("_b"))
    key = nodes.join(seen, "id", "left")
    name = key.groupBy(color, "_n", "_a", "_b").agg(F.min("id").alias("_new"))
    same = [key[c].eqNullSafe(name[c]) for c in (color, "_n", "_a", "_b")]
    cond = same[0] & same[1] & same[2] & same[3]
    return key.join(name, cond).select(key["id"], *[key[c] for c in nodes.columns if c not in ("id", color)],
                                       name["_new"].alias(color))


def wl_histogram(nodes: DataFrame, group: str = "graph_id", color: str = "color") -> DataFrame:
    return nodes.groupBy(group, color).agg(F.count("*").alias("n"))


def gated_graph_conv(g: Graph, weights: Sequence[Matrix], w_ih: Matrix, w_hh: Matrix) -> DataFrame:
    """Propagation steps through a gated recurrent cell (gates ordered reset, update, new)."""
    c = g.dim
    nodes = g.nodes
    for t, w in enumerate(weights):
        m = nodes.withColumn("_h", F.col("x")).withColumn("x", vec.pack(vec.linear(vec.parts("x", c), w)))
        got = propagate(Graph(m, g.edges, c), weighted, out="_m")
        gi, gh = vec.linear(vec.parts("_m", c), w_ih), vec.linear(vec.parts("_h", c), w_hh)
        out = []
        for k in range(c):
            r = vec.sigmoid(gi[k] + gh[k])
            z = vec.sigmoid(gi[c + k] + gh[c + k])
            n = F.tanh(gi[2 * c + k] + r * gh[2 * c + k])
            out.append((1 - z) * n + z * F.col("_h")[k])
        nodes = got.withColumn("x", vec.pack(out)).drop("_m", "_h")
        if (t + 1) % 3 == 0:
            nodes = cut(nodes)
    return done(nodes, vec.parts("x", c))


def dna_conv(g: Graph, history: Sequence[str], wq: Matrix, wk: Matrix, wv: Matrix) -> DataFrame:
    """Each edge attends from the target's last layer over the source's layer history.

    Restricted softmax: exp(s - max(s, 0)) over a denominator that also holds exp(0 - ..).
    """
    norm = gcn_norm(g.edges, g.nodes)
    c = len(wq[0])
    def message(j: Side, i: Side) -> Cols:
        q = vec.linear(i.vec(history[-1]), wq)
        s = [vec.dot(q, vec.linear(j.vec(h), wk)) / math.sqrt(c) for h in history]
        top = F.greatest(F.lit(0.0), *s)
        e = [F.exp(v - top) for v in s]
        den = vec.add_all(e) + F.exp(-top)
        vals = [vec.linear(j.vec(h), wv) for h in history]
        return [F.col("w") * vec.add_all([p / den * v[k] for p, v in zip(e, vals)]) for k in range(c)]
    return propagate(g.with_edges(norm), message).select("id", "out")


def meta_layer(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, edge_fn=None, node_fn=None, graph_fn=None):
    """Edge, node and graph update hooks in turn; each gets and returns tables."""
    if edge_fn:
        edges = edge_fn(nodes, edges, graphs)
    if node_fn:
        nodes = node_fn(nodes, edges, graphs)
    if graph_fn:
        graphs = graph_fn(nodes, edges, graphs)
    return nodes, edges, graphs
