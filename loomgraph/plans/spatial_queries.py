"""Neighbour joins over the embedding vectors and order lines."""
import math

from pyspark.sql import functions as F

from ..core import vec
from ..graph import Graph
from ..operators import conv as C
from ..operators import spatial as S
from .catalog import query
from .conv_queries import V, W, lin, out, rnd
from .reduce_queries import flat, rounded, rounded_sql

PAIR = """d as (select a.id as y, b.id as x, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1]-p[2])*(p[1]-p[2]))) as d2 from pts a, pts b),
  r as (select *, row_number() over (partition by y order by d2, x) - 1 as rank from d {w})"""


def d2(df):
    return df.withColumn("d2", F.round("d2", 6))


@query("pts", "with " + PAIR.format(w="where x % 3 = 0 and y % 3 = 1") + " select y, x, round(d2, 6) as d2, rank from r where rank < 5")
def knn_bipartite(t):
    """vectors with label-independent roles: every third is a point, every third a query"""
    return d2(S.knn(t.pts.filter("id % 3 = 0"), t.pts.filter("id % 3 = 1"), 5))


@query("pts", "with " + PAIR.format(w="where x <> y") + " select x as src, y as dst, round(d2, 6) as d2, rank from r where rank < 5")
def knn_graph(t):
    return d2(S.knn_graph(t.pts, 5))


@query("pts", "with " + PAIR.format(w="where true") + " select y as src, x as dst, round(d2, 6) as d2, rank from r where rank < 3")
def knn_graph_loops_reversed(t):
    return d2(S.knn_graph(t.pts, 3, loop=True, flow="target_to_source"))


@query("pts", "with u as (select id, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda e: e*e)))) x from pts), " + PAIR.replace("from pts a, pts b", "from u a, u b").format(w="where x <> y")
       + " select x as src, y as dst, round(1 - d2/2, 6) as cosine, rank from r where rank < 4")
def knn_graph_cosine(t):
    return S.knn_graph(t.pts, 4, cosine=True).select("src", "dst", F.round(1 - F.col("d2") / 2, 6).alias("cosine"), "rank")


LNPAIR = "d as (select a.id as y, b.id as x, (a.x0-b.x0)*(a.x0-b.x0) + (a.x1-b.x1)*(a.x1-b.x1) as d2 from ln a join ln b on a.graph_id = b.graph_id and a.id <> b.id)"


def few(t):
    """rounded features, so ties are exact"""
    return t.lines.withColumn("x", F.array(F.col("x")[0], F.round(F.col("x")[1], 0)))


@query("ln", "with l as (select graph_id, id, x0, round(x1, 0) x1 from ln), " + LNPAIR.replace("from ln a join ln b", "from l a join l b")
       + ", r as (select *, row_number() over (partition by y order by d2, x) k from d) select x as src, y as dst, d2 from r where k <= 2")
def knn_graph_batched(t):
    return S.knn_graph(few(t), 2, group="graph_id").select("src", "dst", "d2")


@query("pts", "with " + PAIR.format(w="where d2 <= 1.1*1.1 and x <> y") + " select x as src, y as dst, round(d2, 6) as d2, rank from r where rank < 32")
def radius_graph(t):
    return d2(S.radius_graph(t.pts, 1.1))


@query("pts", "with " + PAIR.format(w="where d2 <= 1.2*1.2 and x % 3 = 0 and y % 3 = 1") + " select y, x, round(d2, 6) as d2, rank from r where rank < 8")
def radius_capped(t):
    return d2(S.radius(t.pts.filter("id % 3 = 0"), t.pts.filter("id % 3 = 1"), 1.2, max_num_neighbors=8))


@query("pts", "with " + PAIR.format(w="where x % 10 = 0") + " select y as id, x as cluster from r where rank = 0")
def nearest(t):
    return S.nearest(t.pts, t.pts.filter("id % 10 = 0"))


@query("pts", "with " + PAIR.format(w="where x % 2 = 0 and y % 2 = 1") + ", w as (select r.y, 1/greatest(d2,1e-16) w, p.x[1] a, p.x[2] b from r join pts p on p.id = r.x where rank < 3) select y as id, " + rounded_sql("sum(w*a)/sum(w)") + " as x0, " + rounded_sql("sum(w*b)/sum(w)") + " as x1 from w group by 1")
def knn_interpolate(t):
    p = t.pts.withColumn("pos", F.col("x"))
    return flat(S.knn_interpolate(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 3, 2), "id")


# unrolled greedy: half of at most seven points, four steps, start at the smallest id
FPS = "with p0 as (select graph_id, id, x0, x1, ceil(0.5*count(*) over (partition by graph_id)) k, 1e18 m from ln)"
for _s in range(4):
    FPS += (f", c{_s} as (select * from (select *, row_number() over (partition by graph_id order by m desc, id) r from p{_s} where k > {_s}) where r = 1)"
            f", p{_s + 1} as (select p.graph_id, p.id, p.x0, p.x1, p.k, least(p.m, (p.x0-c.x0)*(p.x0-c.x0)+(p.x1-c.x1)*(p.x1-c.x1)) m from p{_s} p join c{_s} c using (graph_id))")


@query("ln", FPS.replace("from ln)", "from (select graph_id, id, x0, round(x1, 0) x1 from ln))") + " " + " union all ".join(f"select graph_id, id, {s} as step from c{s}" for s in range(4)))
def farthest_points(t):
    return S.farthest_points(few(t).withColumn("pos", F.col("x")), 2, 0.5)


NN4 = "with " + PAIR.format(w="where true") + ", e as (select x as src, y as dst, d2 from r where rank < 4)"


@query("pts", NN4 + ", q as (select dst, " + ", ".join(f"max({lin('i.x[1],i.x[2],j.x[1]-i.x[1],j.x[2]-i.x[2]', W + V, k)}) o{k}" for k in (0, 1))
       + " from e join pts j on j.id = src join pts i on i.id = dst group by 1) select dst as id, " + rnd("o0", "o1") + " from q")
def dynamic_edge_conv(t):
    nodes = t.pts.withColumn("full", F.col("x")).withColumn("x", F.slice("x", 1, 2))
    return out(S.dynamic_edge_conv(Graph(nodes, None, 2), 4, lambda z: vec.linear(z, W + V), col="full"))


@query("pts", NN4 + ", h as (select id, x[1] x0, x[2] x1 from pts), q as (select dst, " + ", ".join(
    f"avg(exp(-10*d2)*{lin('x0,x1', W, k)}) m{k}, max(exp(-10*d2)*{lin('x0,x1', W, k)}) t{k}" for k in (0, 1))
       + " from e join h on h.id = src group by 1) select id, " + rnd(*[lin("m0,m1,t0,t1,x0,x1", W + V + W, k) for k in (0, 1)]) + " from q join h on h.id = q.dst")
def gravnet_conv(t):
    near = S.knn_graph(t.pts, 4, loop=True)
    nodes = t.pts.withColumn("x", F.slice("x", 1, 2))
    return out(C.gravnet_conv(Graph(nodes, near, 2), near, W, W + V + W))


@query()
def x_conv(t):
    nodes = t.pts.withColumn("pos", F.slice("x", 1, 3)).withColumn("x", F.slice("x", 4, 2))
    near = S.knn_graph(nodes, 3, col="pos", loop=True).select("src", "dst", "rank")
    lift = [[.3, -.1], [.2, .4], [-.2, .1]]
    transform = [[((r * 7 + c * 3) % 5 - 2) / 10 for c in range(9)] for r in range(9)]
    conv = [[((r * 5 + c) % 7 - 3) / 10 for c in range(2)] for r in range(12)]
    return out(C.x_conv(nodes, near, 3, 3, 2, lift, transform, conv))
