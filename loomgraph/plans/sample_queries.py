"""Samplers, walks, negatives, splits, random graphs."""
from pyspark.sql import functions as F

from ..core import mix
from ..operators import edges as E
from ..operators import sample as S
from .catalog import query
from .edge_queries import hetero


NS = f"""with f0 as (select id from ln where y = 0), l0 as (select src, dst from (select *, row_number() over (partition by dst order by {mix.mix_sql('src', 'dst', seed=1)}, src) r
  from le where dst in (select id from f0)) where r <= 2), f1 as (select id from f0 union select src from l0),
  l1 as (select src, dst from (select *, row_number() over (partition by dst order by {mix.mix_sql('src', 'dst', seed=2)}, src) r from le where dst in (select id from f1)) where r <= 1)
  select 0 as layer, src, dst from l0 union all select 1, src, dst from l1"""


@query("le ln", NS)
def neighbor_sampler(t):
    return S.neighbor_sampler(t.line_edges, t.lines.filter("y = 0"), [2, 1], 1)


@query("spn", f"select id, ({mix.mix_sql('id', seed=9)} % 6)::int as part from spn")
def random_index_parts(t):
    return S.random_parts(t.sp_nodes, 6, 9)


@query("sp spn", f"with p as (select id, ({mix.mix_sql('id', seed=9)} % 6)::int as part from spn) select src, dst, w, a.part from sp join p a on a.id = src join p b on b.id = dst where a.part = b.part")
def random_node_subgraphs(t):
    return S.random_node_subgraphs(t.sp, t.sp_nodes, 6, 9).select("src", "dst", "w", "part")


@query("sp", f"with e as (select src, row_number() over (order by src, dst) - 1 as e from sp), d as (select i // 50 as sample, {mix.mix_sql('i', seed=2)} % (select count(*) from sp) as e from (select unnest(range(0, 200)) as i)) select distinct sample, src as id from d join e using (e)")
def saint_node_samples(t):
    return S.saint_node_samples(t.sp, 50, 4, 2)


@query("sp", f"""with d as (select src, dst, s.sample, ln({mix.unit_sql('src', 'dst', 's.sample', seed=5)})/(count(*) over (partition by src, s.sample) + count(*) over (partition by dst, s.sample)) k
  from sp, (select unnest(range(0, 3))::int as sample) s), r as (select *, row_number() over (partition by sample order by k desc, src, dst) r from d)
  select sample, src as id from r where r <= 40 union select sample, dst from r where r <= 40""")
def saint_edge_samples(t):
    return S.saint_edge_samples(t.sp, 40, 3, 5)


def walk_sql(edges, length, seed):
    ctes = [f"lane as (select src as at_, dst as nxt, row_number() over (partition by src order by dst) - 1 as r, count(*) over (partition by src) d from {edges})",
            "w0 as (select id as walk, id from ln where y = 1)"]
    for k in range(1, length + 1):
        ctes.append(f"w{k} as (select w.walk, coalesce(l.nxt, w.id) as id from w{k-1} w left join (select distinct at_, d from lane) g on g.at_ = w.id left join lane l on l.at_ = w.id and l.r = {mix.mix_sql('w.walk', str(k), seed=seed)} % g.d)")
    return "with " + ", ".join(ctes) + " " + " union all ".join(f"select walk, {k} as step, id from w{k}" for k in range(length + 1))


def starts(t):
    return t.lines.filter("y = 1").select(F.col("id").alias("walk"), "id")


@query("le ln", walk_sql("le", 3, 4))
def random_walks(t):
    return S.random_walks(t.line_edges, starts(t), 3, 4)


@query("le ln", walk_sql("le", 3, 4).replace("with ", "with ", 1).replace("select walk, 0 as step", "select walk, 0 as step") .replace(" select walk, 0 as step, id from w0", ", al as (select walk, 0 as step, id from w0", 1)
       + ") select walk, s.start, step - s.start as pos, id from al join (select unnest(range(0, 3))::int as start) s on step between s.start and s.start + 1")
def walk_contexts(t):
    return S.walk_contexts(S.random_walks(t.line_edges, starts(t), 3, 4), 2)


@query("le ln", f"""with l as (select distinct src, dst from le), w0 as (select id as walk, id from ln where y = 1),
  o1 as (select w.walk, w.id as prev, l.dst as nxt, row_number() over (partition by w.walk order by ln({mix.unit_sql('w.walk', 'l.dst', '1', seed=7)}) desc, l.dst desc) r from w0 w join l on l.src = w.id),
  w1 as (select w0.walk, coalesce(nxt, id) as id, id as prev from w0 left join (select * from o1 where r = 1) o using (walk)),
  o2 as (select w.walk, l.dst as nxt, row_number() over (partition by w.walk order by ln({mix.unit_sql('w.walk', 'l.dst', '2', seed=7)})/(case when l.dst = w.prev then 0.5 when k.dst is not null then 1.0 else 4.0 end) desc, l.dst desc) r
    from w1 w join l on l.src = w.id left join l k on k.src = w.prev and k.dst = l.dst),
  w2 as (select w1.walk, coalesce(nxt, id) as id from w1 left join (select * from o2 where r = 1) o using (walk))
  select walk, 0 as step, id from w0 union all select walk, 1, id from w1 union all select walk, 2, id from w2""")
def biased_walks(t):
    return S.biased_walks(t.line_edges, starts(t), 2, 2.0, 0.25, 7)


META = f"""with w0 as (select c_custkey as walk, c_custkey as id from customer), w1 as (select walk, c_nationkey as id from w0 join customer on c_custkey = id),
  l as (select s_nationkey as n, s_suppkey as s, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as r, count(*) over (partition by s_nationkey) d from supplier),
  w2 as (select w1.walk, coalesce(l.s, -1) as id from w1 left join l on l.n = w1.id and l.r = {mix.mix_sql('w1.walk', '2', seed=3)} % l.d)
  select walk, 0 as step, id from w0 union all select walk, 1, id from w1 union all select walk, 2, id from w2"""


@query("", META)
def metapath_walks(t):
    c = t.read("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    s = t.read("supplier").select(F.col("s_nationkey").cast("bigint").alias("src"), F.col("s_suppkey").alias("dst"))
    return S.metapath_walks([c, s], c.select(F.col("src").alias("walk"), F.col("src").alias("id")), 3)


@query()
def saint_walk_samples(t):
    return S.saint_walk_samples(t.line_edges, t.lines, 50, 2, 4)


SMP = "s as (select id % 3 as sample, id from spn where id % 5 < 3 union select (id + 1) % 3, id from spn where id % 7 < 3)"


def samples(t):
    n = t.sp_nodes
    return n.filter("id % 5 < 3").select((F.col("id") % 3).alias("sample"), "id").unionAll(
        n.filter("id % 7 < 3").select(((F.col("id") + 1) % 3).alias("sample"), "id")).distinct()


@query("sp spn", "with " + SMP + " select s.sample, src, dst, w from sp join s on s.id = src join s z on z.id = dst and z.sample = s.sample")
def saint_subgraphs(t):
    return S.saint_subgraphs(t.sp, samples(t)).select("sample", "src", "dst", "w")


@query("spn", "with " + SMP + " select n.id, round(3.0/coalesce(c, 0.1)/(select count(*) from spn), 8) as norm from spn n left join (select id, count(*) c from s group by 1) q on q.id = n.id")
def saint_node_norm(t):
    node, _ = S.saint_norms(t.sp, t.sp_nodes, samples(t), 3)
    return node.select("id", F.round("norm", 8).alias("norm"))


@query("sp spn", "with " + SMP + """, c as (select id, count(*) c from s group by 1), u as (select src, dst, count(*) e from sp join s on s.id = src join s z on z.id = dst and z.sample = s.sample group by 1, 2)
  select sp.src, sp.dst, round(case when e is not null then least(c/e, 1e4) when c is not null then 1e4 else 0.1 end, 8) as norm from sp left join u on u.src = sp.src and u.dst = sp.dst left join c on c.id = sp.src""")
def saint_edge_norm(t):
    _, edge = S.saint_norms(t.sp, t.sp_nodes, samples(t), 3)
    return edge.select("src", "dst", F.round("norm", 8).alias("norm"))


@query("sp spn", "select src, dst, w from sp join spn a on a.id = src join spn b on b.id = dst where a.y in (0, 2) and b.y in (0, 2)")
def cluster_loader(t):
    return S.cluster_loader(t.sp, t.sp_nodes.select("id", F.col("y").alias("part")), [0, 2])



SN = "n as (select max(l_suppkey) + 1 as n from lineitem), e as (select distinct l_suppkey as src, l_partkey % n as dst from lineitem, n where l_quantity > 48)"


def all_square_edges(t):
    li = t.read("lineitem")
    n = li.agg(F.max("l_suppkey") + 1).first()[0]
    return li.select("l_quantity", F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")), n


def square_edges(t):
    """the part of the edges that ``SN`` names"""
    e, n = all_square_edges(t)
    return e.filter("l_quantity > 48").select("src", "dst").distinct(), n


@query("", "with " + SN + f""", c as (select count(*) m, n from e, n group by n), k as (select *, least(500, n*n-m) as want, floor(least(500, n*n-m)*abs(1/(1-1.1*m/(n*n))))::bigint + 1 as draws from c),
  p as (select i as draw, {mix.mix_sql('i', seed=11)} % n as src, {mix.mix_sql('i', seed=12)} % n as dst from (select unnest(range(0, draws)) as i, n from k)),
  f as (select src, dst, min(draw) d from p where (src, dst) not in (select (src, dst) from e) group by 1, 2)
  select src, dst from (select *, row_number() over (order by d) r from f) where r <= (select want from k)""")
def negative_edges(t):
    e, n = square_edges(t)
    return S.negative_edges(e, n, 500, 11)


@query()
def negative_edges_undirected(t):
    e, n = all_square_edges(t)
    return S.negative_edges(e, n, 500, 11, undirected=True)


@query("", "with recursive " + SN + f""", d as (select src, dst, 0 as k, {mix.mix_sql('src', 'dst', '0', seed=13)} % n as neg from e, n union all
  select d.src, d.dst, k + 1, {mix.mix_sql('d.src', 'd.dst', 'k + 1', seed=13)} % n from d, n where exists (select 1 from e where e.src = d.src and e.dst = d.neg))
  select src, dst, arg_max(neg, k) as neg from d group by 1, 2""")
def structured_negatives(t):
    e, n = square_edges(t)
    return S.structured_negatives(e, n, 13)


@query("ln le", f"""with p as (select graph_id, id, row_number() over (partition by graph_id order by id) - 1 as pos, count(*) over (partition by graph_id) n from ln),
  g as (select distinct a.graph_id, src, dst, n from le join p a on a.id = src), d as (select distinct graph_id, {mix.mix_sql('src', 'dst', seed=3)} % n as a, {mix.mix_sql('src', 'dst', seed=4)} % n as b from g)
  select d.graph_id, x.id as src, y.id as dst from d join p x on x.graph_id = d.graph_id and x.pos = a join p y on y.graph_id = d.graph_id and y.pos = b
  anti join g on g.src = x.id and g.dst = y.id""")
def batched_negatives(t):
    return S.batched_negatives(t.lines, t.line_edges, seed=3)


@query("le", f"""with r as (select src, dst, row_number() over (order by {mix.mix_sql('src', 'dst', seed=6)}, src, dst) - 1 as r, count(*) over () n from (select distinct src, dst from le where src < dst)),
  s as (select src, dst, case when r < floor(n*0.1) then 'val' when r < floor(n*0.1) + floor(n*0.2) then 'test' else 'train' end as split from r)
  select src, dst, split from s union all select dst, src, split from s where split = 'train'""")
def split_edges(t):
    return S.split_edges(t.line_edges, 0.1, 0.2, 6)


@query("", """with n as (select max(n_nationkey) + 1 h, (select max(s_suppkey) + 1 from supplier) w from nation), v as (select r, c, h, w from (select unnest(range(0, h)) as r, h, w from n), lateral (select unnest(range(0, w)) as c))
  select r*w + c as src, (r+a)*w + c+b as dst from v, (select unnest([-1,0,1]) as a), (select unnest([-1,0,1]) as b) where r+a between 0 and h-1 and c+b between 0 and w-1""")
def grid_graph(t):
    h = t.read("nation").agg(F.max("n_nationkey") + 1).first()[0]
    w = t.read("supplier").agg(F.max("s_suppkey") + 1).first()[0]
    return S.grid_graph(t.spark, h, w)


def part_ids(t):
    return t.read("part").select(F.col("p_partkey").alias("id"))


@query()
def erdos_renyi(t):
    return S.gnp_edges(part_ids(t), 0.003, seed=2)


@query()
def stochastic_block_model(t):
    n = t.read("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("block"))
    return S.block_model_edges(n, [[0.004, 0.001], [0.001, 0.002]], seed=2)


@query()
def barabasi_albert(t):
    return S.preferential_edges(part_ids(t), 3, seed=2)
