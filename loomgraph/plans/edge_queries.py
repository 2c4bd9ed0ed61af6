"""Edge-table rewrites on the supplier-part, order-line and event graphs."""
from pyspark.sql import functions as F

from ..core import mix
from ..operators import edges as E
from .catalog import query

LOOPED = """with e as (select src, dst, w from sp where dst % 7 <> 0
  union all select src, src, 2.0*count(*) from sp where src % 4 = 0 group by src)"""


def looped(t):
    """supplier-part edges without every seventh part, plus loops on some suppliers"""
    loops = t.sp.filter("src % 4 = 0").groupBy("src").agg((F.count("*") * 2.0).alias("w")).select(
        "src", F.col("src").alias("dst"), "w")
    return t.sp.filter("dst % 7 <> 0").unionByName(loops)


@query("sp", LOOPED + " select count(*) filter (where src = dst) > 0 as has_loops from e")
def contains_self_loops(t):
    return E.contains_self_loops(looped(t))


@query("sp", LOOPED + " select src, dst, w from e where src <> dst")
def remove_self_loops(t):
    return E.remove_self_loops(looped(t))


@query("sp", LOOPED + " select src, dst, w, src = dst as is_loop from e")
def segregate_self_loops(t):
    rest, loops = E.segregate_self_loops(looped(t))
    return rest.withColumn("is_loop", F.lit(False)).unionByName(
        loops.withColumn("is_loop", F.lit(True)))


@query("sp spn", LOOPED + " select src, dst, w from e union all select id, id, 1.0 from spn")
def add_self_loops(t):
    return E.add_self_loops(looped(t), t.sp_nodes)


@query("sp spn", LOOPED + """ select src, dst, w from e where src <> dst union all
  select id, id, coalesce(l.w, 1.0) from spn left join (select src, w from e where src = dst) l on l.src = id""")
def add_remaining_self_loops(t):
    return E.add_remaining_self_loops(looped(t), t.sp_nodes)


@query("sp spn", LOOPED + """ select count(distinct id) < (select count(*) from spn) as isolated from
  (select src as id from e where src <> dst union all select dst from e where src <> dst)""")
def contains_isolated_nodes(t):
    return E.contains_isolated_nodes(looped(t), t.sp_nodes)


ISOLATED = LOOPED + """, linked as (select distinct id from (select src as id from e where src <> dst
  union all select dst from e where src <> dst)),
  map as (select id, row_number() over (order by id) - 1 as new_id from linked)"""


@query("sp", ISOLATED + """ select a.new_id as src, b.new_id as dst, e.w from e
  join map a on a.id = e.src join map b on b.id = e.dst""")
def remove_isolated_nodes(t):
    return E.remove_isolated_nodes(looped(t))[0].select("src", "dst", "w")


@query("sp spn", ISOLATED + " select n.id, n.kind, n.x0, n.x1 from spn n semi join linked l on l.id = n.id")
def drop_isolated_attributes(t):
    return E.drop_isolated(t.sp_nodes, looped(t)).select(
        "id", "kind", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("sp", "select (select count(*) from sp a left join sp b on a.src=b.dst and a.dst=b.src and a.w=b.w where b.src is null) = 0 as undirected")
def is_undirected_no(t):
    return E.is_undirected(t.sp)


@query("spu", "select (select count(*) from spu a left join spu b on a.src=b.dst and a.dst=b.src and a.w=b.w where b.src is null) = 0 as undirected")
def is_undirected_yes(t):
    return E.is_undirected(t.spu)


@query("ev", "select src, dst from ev union select dst, src from ev")
def to_undirected(t):
    return E.to_undirected(t.ev.select("src", "dst"))


@query("ev", """select src, dst, round(sum(msg), 4) as w from (select src, dst, msg from ev
  union all select dst, src, msg from ev) group by 1, 2""")
def to_undirected_weighted(t):
    return E.to_undirected_weighted(t.ev.withColumn("w", F.col("msg"))).select(
        "src", "dst", F.round("w", 4).alias("w"))


@query("ev", "select src, dst, round(sum(msg), 4) as w from ev group by 1, 2")
def coalesce_edges(t):
    return E.coalesce_edges(t.ev.withColumn("w", F.col("msg"))).select(
        "src", "dst", F.round("w", 4).alias("w"))


@query("ev", "select max(n) <= 1 as coalesced from (select count(*) n from ev group by src, dst)")
def is_coalesced(t):
    return E.is_coalesced(t.ev)


@query("sp", "select src, dst, w from sp order by src, dst")
def sort_edge_index(t):
    return E.sort_edge_index(t.sp)


@query("sp", "select dst, src, w from sp")
def to_sparse_rows(t):
    return E.to_sparse_rows(t.sp)


@query("sp", f"select src, dst, w from sp where {mix.unit_sql('src', 'dst', seed=3)} >= 0.3")
def dropout_edges(t):
    return E.dropout_edges(t.sp, 0.3, seed=3)


@query("le", f"""with k as (select src, dst, w from le where src < dst and {mix.unit_sql('src', 'dst', seed=5)} >= 0.4)
  select src, dst, w from k union all select dst, src, w from k""")
def dropout_edges_undirected(t):
    return E.dropout_edges(t.line_edges, 0.4, seed=5, undirected=True)


@query("sp", "select src, dst, w from sp where w >= 40")
def filter_edges(t):
    return E.filter_edges(t.sp, F.col("w") >= 40)


@query("spn sp", "select id, id in (select src from sp where w > 60 union all select dst from sp where w > 60) as mask from spn")
def index_to_mask(t):
    return E.index_to_mask(t.sp_nodes, E.endpoints(t.sp.filter("w > 60")))


SUB = "with s as (select id, row_number() over (order by x1 desc, id) - 1 as pos from spn where x1 >= 12)"


@query("sp spn", SUB + " select src, dst, w from sp where src in (select id from s) and dst in (select id from s)")
def induced_subgraph(t):
    return E.subgraph(t.sp, t.sp_nodes.filter(F.col("x")[1] >= 12))


@query("sp spn", SUB + " select a.pos as src, b.pos as dst, w from sp join s a on a.id = src join s b on b.id = dst")
def induced_subgraph_relabelled(t):
    from ..core.ranges import global_index
    chosen = t.sp_nodes.filter(F.col("x")[1] >= 12).select("id", F.col("x")[1].alias("x1"))
    return E.subgraph_relabelled(t.sp, global_index(chosen, [F.col("x1").desc(), F.col("id")], "pos"))


HOPS = """with s as (select id from ln where y = 0 and x0 >= 90),
  h1 as (select distinct src as id from le where dst in (select id from s) and src not in (select id from s)),
  h2 as (select distinct src as id from le where dst in (select id from h1)
         and src not in (select id from s) and src not in (select id from h1)),
  r as (select id, 0 as hop from s union all select id, 1 from h1 union all select id, 2 from h2)"""


@query("le ln", HOPS + " select id, hop from r")
def k_hop_nodes(t):
    return E.k_hop_nodes(t.line_edges, t.lines.filter("y = 0 and x[0] >= 90"), 2)


@query("le ln", HOPS + """, k as (select id, row_number() over (order by id) - 1 as n from r)
  select a.n as src, b.n as dst, w from le join k a on a.id = src join k b on b.id = dst""")
def k_hop_subgraph(t):
    nodes, edges = E.k_hop_subgraph(t.line_edges, t.lines.filter("y = 0 and x[0] >= 90"), 2)
    return E.relabel(edges, nodes)


@query("sp", "select max(greatest(src, dst)) + 1 as n from sp")
def num_nodes(t):
    return E.node_count(t.sp)


HET = """with e as (
  select 'customer' as src_type, 'lives_in' as rel, 'nation' as dst_type, c_custkey as src, c_nationkey::bigint as dst from customer
  union all select 'nation', 'part_of', 'region', n_nationkey::bigint, n_regionkey::bigint from nation
  union all select 'supplier', 'lives_in', 'nation', s_suppkey, s_nationkey::bigint from supplier),
  n as (select 'customer' as type, c_custkey as id from customer union all select 'nation', n_nationkey from nation
  union all select 'region', r_regionkey from region union all select 'supplier', s_suppkey from supplier)"""


def hetero(t):
    c, n = t.read("customer"), t.read("nation")
    s, r = t.read("supplier"), t.read("region")

    def typed(df, st, rel, dt, a, b):
        return df.select(F.lit(st).alias("src_type"), F.lit(rel).alias("rel"), F.lit(dt).alias("dst_type"),
                         F.col(a).cast("bigint").alias("src"), F.col(b).cast("bigint").alias("dst"))

    def ids(df, kind, c):
        return df.select(F.lit(kind).alias("type"), F.col(c).cast("bigint").alias("id"))

    edges = (typed(c, "customer", "lives_in", "nation", "c_custkey", "c_nationkey")
             .unionAll(typed(n, "nation", "part_of", "region", "n_nationkey", "n_regionkey"))
             .unionAll(typed(s, "supplier", "lives_in", "nation", "s_suppkey", "s_nationkey")))
    nodes = (ids(c, "customer", "c_custkey").unionAll(ids(n, "nation", "n_nationkey"))
             .unionAll(ids(r, "region", "r_regionkey")).unionAll(ids(s, "supplier", "s_suppkey")))
    return nodes, edges


@query("", HET + """ select type, max(id) + 1 as n from (select src_type as type, src as id from e
  union all select dst_type, dst from e) group by 1""")
def num_nodes_by_type(t):
    return E.node_count_by_type(hetero(t)[1])


OFF = HET + """, o as (select type, coalesce(sum(c) over (order by type rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from (select type, max(id) + 1 as c from n group by 1))"""


@query("", OFF + """ select src + a.off as src, dst + b.off as dst, rel from e
  join o a on a.type = src_type join o b on b.type = dst_type""")
def group_hetero_edges(t):
    return E.group_hetero(*hetero(t))[1]


@query("", OFF + " select id + off as id, n.type, id as local_id from n join o on o.type = n.type")
def group_hetero_nodes(t):
    return E.group_hetero(*hetero(t))[0]


@query("ln", """with p as (select graph_id, id, x0, row_number() over (partition by graph_id order by id) - 1 as pos from ln),
  g as (select graph_id, unnest(range(0, 7)) as pos from (select distinct graph_id from ln))
  select g.graph_id, g.pos, coalesce(p.x0, 0) as q, p.id is not null as mask from g
  left join p on p.graph_id = g.graph_id and p.pos = g.pos""")
def to_dense_batch(t):
    return E.to_dense_batch(t.lines.select("graph_id", "id", F.col("x")[0].alias("q")), "q", size=7)


DENSE = """with p as (select graph_id, id, row_number() over (partition by graph_id order by id) - 1 as pos from ln),
  c as (select a.graph_id, a.pos as i, b.pos as j, sum(w) as w from le join p a on a.id = src join p b on b.id = dst group by 1, 2, 3)"""


@query("ln le", DENSE + """ select graph_id, i, round(coalesce(max(case when j = 0 then w end), 0), 4) as c0,
  round(coalesce(max(case when j = 1 then w end), 0), 4) as c1, round(coalesce(max(case when j = 2 then w end), 0), 4) as c2
  from (select g.graph_id, g.i, c.j, c.w from (select graph_id, unnest(range(0, 7)) as i from (select distinct graph_id from ln)) g
  left join c on c.graph_id = g.graph_id and c.i = g.i) group by 1, 2""")
def to_dense_adj(t):
    rows = E.to_dense_adj(t.lines, t.line_edges, size=7)
    return rows.select("graph_id", "i", *[F.round(F.col("row")[k], 4).alias(f"c{k}") for k in range(3)])


@query("ln le", DENSE + " select graph_id, i as src, j as dst, w from c where w <> 0")
def dense_to_sparse(t):
    return E.dense_to_sparse(E.to_dense_adj(t.lines, t.line_edges, size=7))


@query("", """select l_orderkey as src, unnest(list(distinct l_partkey)) as dst from lineitem group by 1""")
def edges_from_adjacency(t):
    lists = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list("l_partkey").alias("neighbours"))
    return E.edges_from_adjacency(lists)
