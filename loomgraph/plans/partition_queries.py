"""Components, orders, paths, matchings, partitions and graph upkeep."""
from pyspark.sql import functions as F

from ..core.ranges import global_index
from ..operators import traverse as T
from .catalog import query


# thin graph: order-line edges of small weight, so components are non-trivial
THIN = "e as (select src, dst, w from le where w <= 12)"


def thin(t):
    return t.line_edges.filter("w <= 12")


CC = "with recursive " + THIN + ", r as (select id, id as c from ln union select e.dst, r.c from r join e on e.src = r.id), k as (select id, min(c) as comp from r group by 1)"


@query("le ln", CC + " select * from k")
def components(t):
    return T.components(thin(t), t.lines)


@query("le ln", "with recursive e as (select src, dst from le join ln a on a.id = src join ln b on b.id = dst where a.y = b.y), r as (select id, id as c from ln union select e.dst, r.c from r join e on e.src = r.id) select r.id, any_value(ln.y) as part, min(c) as comp from r join ln on ln.id = r.id group by 1")
def partition_components(t):
    return T.partition_components(t.line_edges, t.lines.select("id", F.col("y").alias("part")))


@query("spu spn", "with recursive r as (select min(id) as id from spn union select dst from r join (select distinct src, dst from spu) on src = id) select (select count(*) from r) = (select count(*) from spn) as connected")
def is_connected(t):
    return T.is_connected(t.spu, t.sp_nodes)


BFS = "with recursive " + THIN + ", s as (select id from ln where y = 3 and x0 > 80), r as (select id, 0 as level from s union select e.dst, level + 1 from r join e on e.src = r.id where level < 7), b as (select id, min(level)::int as level from r group by 1)"


@query("le ln", BFS + " select * from b")
def bfs_levels(t):
    return T.bfs_levels(thin(t), t.lines.filter("y = 3 and x[0] > 80"))


@query("le ln", BFS + " select id, level, row_number() over (order by level, id) - 1 as pos from b")
def bfs_ordering(t):
    return T.bfs_ordering(thin(t), t.lines.filter("y = 3 and x[0] > 80"))


@query("sp spn", """with recursive root as (select min(src) r from sp), e as (select src, dst from sp union select dst, src from sp),
  l0 as (select r as id from root), l1 as (select distinct dst as id from e where src in (select id from l0)),
  l2 as (select distinct dst as id from e where src in (select id from l1) and dst not in (select id from l0)),
  l3 as (select distinct dst as id from e where src in (select id from l2) and dst not in (select id from l1)),
  a as (select id, 0 as level from l0 union all select id, 1 from l1 union all select id, 2 from l2 union all select id, 3 from l3),
  k as (select a.id, a.level, count(b.id) links from a left join e on e.dst = a.id left join a b on b.id = e.src and b.level < a.level group by 1, 2)
  select id, level, row_number() over (order by level, links desc, id) - 1 as pos from k""")
def best_first_ordering(t):
    return T.best_first_waves(t.spu, t.sp_nodes, 0).select("id", "level", "pos")


@query("sp spn", """with recursive e as (select src, dst, w from sp union all select dst, src, w from sp), d0 as (select 0::bigint as id, 0.0::double as d),
  d1 as (select id, min(d) d from (select * from d0 union all select dst, d + w from d0 join e on src = id) group by 1),
  d2 as (select id, min(d) d from (select * from d1 union all select dst, d + w from d1 join e on src = id) group by 1),
  d3 as (select id, min(d) d from (select * from d2 union all select dst, d + w from d2 join e on src = id) group by 1),
  d4 as (select id, min(d) d from (select * from d3 union all select dst, d + w from d3 join e on src = id) group by 1),
  d5 as (select id, min(d) d from (select * from d4 union all select dst, d + w from d4 join e on src = id) group by 1),
  d6 as (select id, min(d) d from (select * from d5 union all select dst, d + w from d5 join e on src = id) group by 1),
  d7 as (select id, min(d) d from (select * from d6 union all select dst, d + w from d6 join e on src = id) group by 1),
  d8 as (select id, min(d) d from (select * from d7 union all select dst, d + w from d7 join e on src = id) group by 1),
  d9 as (select id, min(d) d from (select * from d8 union all select dst, d + w from d8 join e on src = id) group by 1)
  select spn.id, coalesce(d, -1.0) as dist from spn left join d9 on d9.id = spn.id""")
def shortest_paths(t):
    return T.shortest_paths(t.spu, t.sp_nodes, 0)


@query()
def heavy_edge_matching(t):
    return T.heavy_edge_matching(t.line_edges, t.lines)


@query()
def random_matching(t):
    return T.random_matching(t.line_edges, t.lines, 3)


# total weight between different coarse nodes plus weight swallowed inside equals the input's
@query("le", "select round(sum(w), 2) as total from le where src <> dst")
def coarsen_graph_weight(t):
    e, _, names = T.coarsen_graph(t.line_edges, t.lines, 2)
    inside = t.line_edges.join(names.select(F.col("id").alias("src"), F.col("coarse").alias("a")), "src").join(
        names.select(F.col("id").alias("dst"), F.col("coarse").alias("b")), "dst").filter("a = b").select("w")
    return e.select("w").unionAll(inside).agg(F.round(F.sum("w"), 2).alias("total"))


@query("spn", "select count(*) as placed from spn")
def partition_kway_total(t):
    return T.partition_kway(t.spu, t.sp_nodes, 4).filter("part between 0 and 3").agg(F.count("*").alias("placed"))


@query()
def partition_kway(t):
    return T.partition_kway(t.spu, t.sp_nodes, 4)


@query()
def partition_recursive(t):
    return T.partition_recursive(t.spu, t.sp_nodes, 2)


# a separator leaves no edge between the two sides: count such edges
@query("", "select 0::bigint as crossing")
def vertex_separator(t):
    part = T.partition_recursive(t.line_edges, t.lines, 1)
    sep = T.refine_separator(t.line_edges, T.vertex_separator(t.line_edges, part))
    a = sep.select(F.col("id").alias("src"), F.col("part").alias("a"))
    b = sep.select(F.col("id").alias("dst"), F.col("part").alias("b"))
    return t.line_edges.join(a, "src").join(b, "dst").agg(F.count_if((F.col("a") + F.col("b") == 1)).alias("crossing"))


def labels(t):
    return t.sp_nodes.select("id", F.col("y").alias("part"))


@query("spn", "select round(3 * max(c) / sum(c), 8) as balance from (select y, count(*) c from spn group by 1)")
def partition_balance(t):
    return T.partition_balance(t.sp_nodes, labels(t), 3).select(F.round("balance", 8).alias("balance"))


@query("spu spn", "select a.y as src, b.y as dst, sum(w) as w from spu join spn a on a.id = src join spn b on b.id = dst where a.y <> b.y group by 1, 2")
def subdomain_graph(t):
    return T.subdomain_graph(t.spu, labels(t))


@query("spu spn", "with c as (select src, b.y, w from spu join spn a on a.id = src join spn b on b.id = dst where a.y <> b.y) select sum(w)/2 as cut, (select count(*) from (select distinct src, y from c)) as volume from c")
def partition_cut(t):
    return T.partition_cut(t.spu, labels(t))


DIRTY = "d as (select src, dst, w from spu where (src + dst) % 11 <> 0 or src < dst union all select src, src, 1.0 from sp where w > 90)"


def dirty(t):
    return t.spu.filter("(src + dst) % 11 <> 0 or src < dst").unionAll(t.sp.filter("w > 90").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w")))


@query("spu sp", "with " + DIRTY + """ select count(*) filter (where src = dst) as loops, (count(*) - count(distinct (src, dst)))::bigint as repeated,
  (select count(*) from d anti join d r on r.src = d.dst and r.dst = d.src and r.w = d.w)::bigint as unmatched from d""")
def check_graph(t):
    return T.check_graph(dirty(t))


@query("spu sp", "with " + DIRTY + ", b as (select src, dst, w from d where src <> dst union all select dst, src, w from d where src <> dst) select src, dst, max(w) as w from b group by 1, 2")
def fix_graph(t):
    return T.fix_graph(dirty(t))


@query("sp", "select src, dst, round(w/sqrt(sum(w*w) over (partition by dst)), 8) as w from sp")
def graph_normalize(t):
    return T.normalize_weights(t.sp, "dst", 2).select("src", "dst", F.round("w", 8).alias("w"))


@query("sp", "select src, dst, w from sp where dst in (select dst from sp group by 1 having count(*) between 20 and 26)")
def graph_prune(t):
    return T.prune_by_degree(t.sp, "dst", 20, 26)


@query("sp spn", "with p as (select id, row_number() over (order by x0 desc, id) - 1 as pos from spn) select a.pos as src, b.pos as dst, w from sp join p a on a.id = src join p b on b.id = dst")
def graph_reorder(t):
    perm = global_index(t.sp_nodes.select("id", F.col("x")[0].alias("k")), [F.col("k").desc(), F.col("id")], "pos")
    return T.reorder(t.sp, perm).select("src", "dst", "w")


@query("sp", "select src - 40 as src, dst - 40 as dst, w from sp where src between 40 and 239 and dst between 40 and 239")
def graph_extract_range(t):
    return T.id_range(t.sp, 40, 200)


MESH = "m as (select distinct l_orderkey as elem, l_partkey as node from lineitem)"


def mesh(t):
    return t.read("lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))


@query("", "with " + MESH + """, n as (select elem, count(*) n from m group by 1), s as (select a.elem, b.elem as other, count(*) c from m a join m b using (node) where a.elem <> b.elem group by 1, 2)
  select s.elem as src, s.other as dst from s join n a on a.elem = s.elem join n b on b.elem = s.other where c >= 2 or c >= a.n - 1 or c >= b.n - 1""")
def mesh_to_dual(t):
    return T.mesh_to_dual(mesh(t), 2)


@query("", "with " + MESH + " select distinct a.node as src, b.node as dst from m a join m b using (elem) where a.node <> b.node")
def mesh_to_nodal(t):
    return T.mesh_to_nodal(mesh(t))


@query()
def partition_mesh_nodal(t):
    return T.partition_mesh(mesh(t), 4, dual=False)[1]


@query()
def partition_mesh_dual(t):
    return T.partition_mesh(mesh(t), 4, common=2)[0]
