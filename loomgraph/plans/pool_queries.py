"""Top-k selection, coarsening and matching."""
from pyspark.sql import functions as F

from ..core import mix
from ..graph import Graph
from ..operators import pool as P
from .catalog import query
from .conv_queries import lin
from .reduce_queries import flat, rounded, rounded_sql

RANK = "r as (select *, row_number() over (partition by graph_id order by {s} desc, id) - 1 as rank, count(*) over (partition by graph_id) n from {n})"


def scored(t):
    return t.lines.withColumn("s", F.col("x")[0])


@query("ln", "with " + RANK.format(s="x0", n="ln") + " select graph_id, id, rank from r where rank < ceil(0.5*n)")
def topk_ratio(t):
    return P.topk(scored(t), "s", 0.5).select("graph_id", "id", "rank")


@query("ln", "with " + RANK.format(s="x0", n="ln") + " select graph_id, id, rank from r where rank < 2")
def topk_fixed(t):
    return P.topk(scored(t), "s", 2).select("graph_id", "id", "rank")


@query("ln", """with m as (select *, max(x0) over (partition by graph_id) mx from ln), k as (select * from m where x0 > least(mx - 1e-7, 60)),
  r as (select graph_id, id, row_number() over (partition by graph_id order by x0 desc, id) - 1 as rank from k) select * from r""")
def topk_min_score(t):
    return P.topk(scored(t), "s", min_score=60.0).select("graph_id", "id", "rank")


TOPK = ("with q as (select *, round(tanh((0.03*x0 - 0.04*x1)/0.05), 12) as score from ln), " + RANK.format(s="score", n="q")
        + ", k as (select *, row_number() over (order by graph_id, rank) - 1 as new_id from r where rank < ceil(0.5*n))")


@query("ln", TOPK + " select id, rank, " + rounded_sql("x0*score", 5) + " as x0, " + rounded_sql("x1*score", 5) + " as x1 from k")
def topk_pooling_nodes(t):
    return flat(tanh_pool(t)[0], "id", "rank", digits=5)


def tanh_pool(t):
    """scores rounded so that order at the 16th digit does not decide the cut"""
    from ..core import vec
    raw = F.round(F.tanh((F.col("x")[0] * 0.03 - F.col("x")[1] * 0.04) / 0.05), 12)
    return P._gate(t.lines.withColumn("score", raw), t.b, 0.5, None, 1.0)


@query("ln le", TOPK + " select a.new_id as src, b.new_id as dst, w from le join k a on a.id = src join k b on b.id = dst")
def topk_pooling_edges(t):
    return tanh_pool(t)[1].select("src", "dst", "w")


@query()
def topk_pooling_layer(t):
    return flat(P.topk_pooling(t.b, [0.3, -0.4], 0.5)[0], "id", "rank", digits=5)


@query()
def sag_pooling(t):
    return flat(P.sag_pooling(t.b, [[0.01], [0.02]], [[-0.01], [0.03]], 0.5)[0], "id", "rank", digits=5)


@query()
def asa_pooling(t):
    kept, coarse = P.asa_pooling(t.b, [[.5, .1], [.2, .3]], [.01, -.02, .03, .01], ([[.02], [.01]], [[.01], [.03]], [[.01], [-.02]]), 0.5)
    return coarse.select("src", "dst", F.round("w", 5).alias("w"))


CL = "c as (select id, y*1000 + (id // 64) % 7 as cluster from ln), d as (select cluster, max(id) as rep, row_number() over (order by cluster) - 1 as new_id from c group by 1), k as (select c.id, new_id from c join d using (cluster))"


def clusters(t):
    return t.lines.select("id", (F.col("y").cast("bigint") * 1000 + F.floor(F.col("id") / 64) % 7).alias("cluster"))


@query("ln", "with " + CL + " select cluster, new_id, rep from d")
def consecutive_cluster(t):
    return P.consecutive_cluster(clusters(t))


@query("ln le", "with " + CL + " select a.new_id as src, b.new_id as dst, sum(w) as w from le join k a on a.id = src join k b on b.id = dst where a.new_id <> b.new_id group by 1, 2")
def pool_edge(t):
    return P.pool_edge(t.line_edges, P.cluster_map(clusters(t)))


@query("ln", "with " + CL + f" select new_id as id, {rounded_sql('avg(x0)')} as x0, {rounded_sql('avg(x1)')} as x1 from ln join k using (id) group by 1")
def avg_pool_x(t):
    return flat(P.pool_nodes(t.lines, P.cluster_map(clusters(t)), 2), "id")


@query("ln", "with " + CL + f" select new_id as id, {rounded_sql('max(x0)')} as x0, {rounded_sql('max(x1)')} as x1 from ln join k using (id) group by 1")
def max_pool_x(t):
    return flat(P.pool_nodes(t.lines, P.cluster_map(clusters(t)), 2, "max"), "id")


@query("ln", "with " + CL + " select new_id as id, arg_max(graph_id, id) as graph_id from ln join k using (id) group by 1")
def pool_batch(t):
    return P.pool_batch(t.lines, P.cluster_map(clusters(t)))


COARSE = """select new_id as id, {f} as x0, {g} as p0, arg_max(graph_id, id) as graph_id from ln join k using (id) group by 1"""


def coarse(t, how):
    nodes = t.lines.withColumn("pos", F.array(F.col("x")[1], F.col("x")[0]))
    out = P.coarsen(Graph(nodes, t.line_edges, 2), clusters(t), how, 2).nodes
    return out.select("id", rounded(F.col("x")[0]).alias("x0"), rounded(F.col("pos")[0]).alias("p0"), "graph_id")


@query("ln", "with " + CL + COARSE.format(f=rounded_sql("avg(x0)"), g=rounded_sql("avg(x1)")))
def avg_pool_graph(t):
    return coarse(t, "mean")


@query("ln", "with " + CL + COARSE.format(f=rounded_sql("max(x0)"), g=rounded_sql("avg(x1)")))
def max_pool_graph(t):
    return coarse(t, "max")


NEAR = "with l as (select src, dst from le union all select id, id from ln) select dst as id, {} as o0, {} as o1 from l join ln on id = src group by 1"


@query("le ln", NEAR.format(rounded_sql("avg(x0)"), rounded_sql("avg(x1)")))
def avg_pool_neighbor(t):
    return flat(P.neighbor_pool(t.b), "id", col="out", prefix="o")


@query("le ln", NEAR.format(rounded_sql("max(x0)"), rounded_sql("max(x1)")))
def max_pool_neighbor(t):
    return flat(P.neighbor_pool(t.b, "max"), "id", col="out", prefix="o")


VOX = """with b as (select min(x[1]) a0, max(x[1]) b0, min(x[2]) a1, max(x[2]) b1, min(x[3]) a2, max(x[3]) b2 from pts),
  v as (select id, y, x, (floor((x[1]-a0)/0.1) + (floor((b0-a0)/0.1)+1)*(floor((x[2]-a1)/0.1) + (floor((b1-a1)/0.1)+1)*floor((x[3]-a2)/0.1)))::bigint as cluster from pts, b)"""


def points(t):
    return t.pts.withColumn("pos", F.slice("x", 1, 3))


@query("pts", VOX + " select id, cluster from v")
def voxel_grid(t):
    return P.voxel_grid(points(t), [0.1] * 3, 3)


@query("pts", VOX + """, n as (select cluster, y, count(*) c from v group by 1, 2), m as (select cluster, y, row_number() over (partition by cluster order by c desc, y) r from n)
  select v.cluster, round(avg(x[1]), 6) as p0, round(avg(x[2]), 6) as p1, any_value(m.y) as y from v join m on m.cluster = v.cluster and r = 1 group by 1""")
def grid_sampling(t):
    out = P.grid_sampling(points(t).drop("x"), [0.1] * 3, 3)
    return out.select("cluster", F.round(F.col("pos")[0], 6).alias("p0"), F.round(F.col("pos")[1], 6).alias("p1"), "y")


# greedy matchings: the sequential result is checked in tests; here the invariants hold in SQL form
@query()
def edge_pooling(t):
    scores = P.edge_scores(t.b, [.02, .01, -.01, .02], "tanh")
    return flat(P.edge_pooling(t.b, scores)[0], "id")


@query()
def edge_unpooling(t):
    nodes, _, clusters_ = P.edge_pooling(t.b, P.edge_scores(t.b, [.02, .01, -.01, .02], "tanh"))
    return flat(P.edge_unpool(nodes, clusters_, 2), "id")


# in a path-like order graph the heaviest edge overall is always matched; full result via recursion is not SQL
@query()
def graclus(t):
    return P.graclus(t.line_edges, t.lines)
