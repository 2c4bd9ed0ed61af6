"""Feature, position and structure transforms, and the dense-batch layers."""
import math

from pyspark.sql import functions as F

from ..core import mix, vec
from ..graph import Graph
from ..operators import dense as D
from ..operators import transforms as T
from .catalog import query
from .conv_queries import B, U, V, W, lin, out, prop, rnd
from .edge_queries import looped
from .reduce_queries import flat, rounded, rounded_sql


@query("spn", "select id, x0, x1, 1.0 as x2 from spn")
def constant_feature(t):
    return T.constant(t.sp_nodes).select("id", *[F.col("x")[k].alias(f"x{k}") for k in range(3)])


@query("ln", f"select id, {rounded_sql('x0/greatest(x0+x1,1)')} as x0, {rounded_sql('x1/greatest(x0+x1,1)')} as x1 from ln")
def normalize_features(t):
    return flat(T.normalize_features(t.lines, 2), "id")


@query("le ln", """with d as (select id, coalesce(c,0) c from ln left join (select src, count(*) c from le group by 1) on src = id)
  select id, (c=0)::int::double as d0, (c=1)::int::double as d1, (c=2)::int::double as d2, (c=3)::int::double as d3, (c=4)::int::double as d4 from d""")
def one_hot_degree(t):
    return T.one_hot_degree(t.b, 4, cat=False).select("id", *[F.col("x")[k].alias(f"d{k}") for k in range(5)])


@query("sp spn", """with e as (select src, dst from sp), d as (select id, coalesce(c,0) c from spn left join (select src, count(*) c from e group by 1) on src = id),
  s as (select src, min(c) lo, max(c) hi, avg(c) m, stddev_samp(c) s from e join d on d.id = e.dst group by 1)
  select id, c::double as deg, coalesce(lo,0)::double as min, coalesce(hi,0)::double as max, round(coalesce(m,0),6) as mean, round(coalesce(s,0),6) as std from d left join s on s.src = d.id""")
def local_degree_profile_directed(t):
    return T.local_degree_profile(Graph(t.sp_nodes, t.sp, 2)).select(
        "id", "deg", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("spu spn", """with e as (select src, dst from spu), d as (select src, count(*) c from e group by 1),
  s as (select e.src, min(c) lo, max(c) hi, avg(c) m, coalesce(stddev_samp(c),0) s from e join d on d.src = e.dst group by 1)
  select id, coalesce(c,0)::double as deg, coalesce(lo,0)::double as min, coalesce(hi,0)::double as max, round(coalesce(m,0),6) as mean, round(coalesce(s,0),6) as std
  from spn left join d on d.src = id left join s on s.src = id""")
def local_degree_profile(t):
    return T.local_degree_profile(t.g).select(
        "id", "deg", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("sp", "with d as (select dst, count(*) c from sp group by 1) select src, e.dst, round(c/(select max(c) from d), 8) as attr from sp e join d on d.dst = e.dst")
def target_indegree(t):
    return T.target_indegree(Graph(t.sp_nodes, t.sp, 2)).select("src", "dst", F.round("attr", 8).alias("attr"))


@query("adj spn", "with " + prop("adj", "spn", "p") + ", q as (select n.id, coalesce(s0,0) q0, coalesce(s1,0) q1 from spn n left join (select e.dst as id, sum(w*p0) s0, sum(w*p1) s1 from adj e join p on p.id = e.src group by 1) z on z.id = n.id) select p.id, "
       + rounded_sql("p0") + " as a0, " + rounded_sql("p1") + " as a1, " + rounded_sql("q0") + " as b0, " + rounded_sql("q1") + " as b1 from p join q on q.id = p.id")
def sign_k2(t):
    n = T.sign(t.g, 2)
    return n.select("id", *[rounded(F.col(c)[k]).alias(f"{p}{k}") for c, p in (("x1", "a"), ("x2", "b")) for k in (0, 1)])


@query("le", """with f as (select distinct a.src, b.dst from le a join le b on a.dst = b.src where a.src <> b.dst)
  select src, dst, sum(w) as w from (select src, dst, w from le union all select src, dst, 0 from f) group by 1, 2""")
def two_hop(t):
    return T.two_hop(t.line_edges)


@query("le1", """with n as (select src, dst, row_number() over (order by src, dst) - 1 as e from le1)
  select a.e as src, b.e as dst from n a join n b on a.dst = b.src""")
def line_graph_directed(t):
    return T.line_graph_directed(t.line_edges.filter("src < dst"))


@query("le", """with n as (select src, dst, row_number() over (order by src, dst) - 1 as e from le where src < dst),
  v as (select e, src as v from n union all select e, dst from n) select distinct a.e as src, b.e as dst from v a join v b using (v) where a.e <> b.e""")
def line_graph_undirected(t):
    return T.line_graph_undirected(t.line_edges)


FACES = "f as (select a.id as a, b.id as b, c.id as c, a.id as face_id from ln a join ln b on b.id = a.id+1 and b.graph_id = a.graph_id join ln c on c.id = a.id+2 and c.graph_id = a.graph_id)"


def faces(t):
    """three consecutive lines of an order form a face"""
    n = t.lines.select("id", "graph_id")
    a = n.select(F.col("id").alias("a"), "graph_id")
    b = n.select((F.col("id") - 1).alias("a"), "graph_id", F.col("id").alias("b"))
    c = n.select((F.col("id") - 2).alias("a"), "graph_id", F.col("id").alias("c"))
    return a.join(b, ["a", "graph_id"]).join(c, ["a", "graph_id"]).select("a", "b", "c", F.col("a").alias("face_id"))


@query("ln", "with " + FACES + ", s as (select a as src, b as dst from f union all select b, c from f union all select a, c from f) select src, dst from s union select dst, src from s")
def face_to_edge(t):
    return T.face_to_edge(faces(t))


@query("ln", "with q as (select a.id as i from ln a join ln d on d.id = a.id+3 and d.graph_id = a.graph_id) select i as a, i+1 as b, i+2 as c from q union all select i, i+2, i+3 from q")
def quads_to_triangles(t):
    n = t.lines.select("id", "graph_id")
    q = n.join(n.select((F.col("id") - 3).alias("id"), "graph_id"), ["id", "graph_id"])
    return T.quads_to_triangles(q.select(F.array(*[F.col("id") + k for k in range(4)]).alias("corners")))


# positions: first three embedding axes; edges join vec ids one and five apart ------------------------

def cloud(t):
    nodes = t.pts.select("id", F.slice("x", 1, 3).alias("pos"), F.slice("x", 4, 3).alias("normal"), (F.col("id") % 5).alias("graph_id"))
    e = nodes.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 5)).alias("dst"))
    e = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("w"))
    return Graph(nodes, e, 3)


CLOUD = """p as (select id, x[1] a, x[2] b, x[3] c, x[4] na, x[5] nb, x[6] nc, id % 5 as g from pts),
  d as (select i.id as src, j.id as dst, j.a-i.a as a, j.b-i.b as b, j.c-i.c as c, i.na, i.nb, i.nc, j.na as ma, j.nb as mb, j.nc as mc from p i join p j on j.id = i.id+1 or j.id = i.id+5)"""
SIZE = "sqrt(a*a+b*b+c*c)"


def attrs(df, n):
    return flat(df, "src", "dst", col="attr", dim=n, prefix="o")


@query("pts", "with " + CLOUD + ", m as (select max(greatest(abs(a),abs(b),abs(c))) m from d) select src, dst, " + rnd("a/(2*m)+0.5", "b/(2*m)+0.5", "c/(2*m)+0.5") + " from d, m")
def cartesian(t):
    return attrs(T.cartesian(cloud(t)), 3)


@query("pts", "with " + CLOUD + ", m as (select *, max(greatest(abs(a),abs(b),abs(c))) over (partition by src) m from d) select src, dst, " + rnd("a/(2*m)+0.5", "b/(2*m)+0.5", "c/(2*m)+0.5") + " from m")
def local_cartesian(t):
    return attrs(T.local_cartesian(cloud(t)), 3)


@query("pts", "with " + CLOUD + f", r as (select *, {SIZE} r from d) select src, dst, " + rnd("r/(max(r) over ())") + " from r")
def distance_attr(t):
    return attrs(T.distance(cloud(t)), 1)


THETA = "case when atan2(b,a) < 0 then atan2(b,a) + 2*pi() else atan2(b,a) end"


@query("pts", "with " + CLOUD + ", r as (select *, sqrt(a*a+b*b) r from d) select src, dst, " + rnd("r/(max(r) over ())", f"({THETA})/(2*pi())") + " from r")
def polar(t):
    g = cloud(t)
    return attrs(T.polar(Graph(g.nodes.withColumn("pos", F.slice("pos", 1, 2)), g.edges, 2)), 2)


@query("pts", "with " + CLOUD + f", r as (select *, {SIZE} r from d) select src, dst, " + rnd("r/(max(r) over ())", f"({THETA})/(2*pi())", "acos(c/r)/pi()") + " from r")
def spherical(t):
    return attrs(T.spherical(cloud(t)), 3)


def ang(u, v):
    (a, b, c), (d, e, f) = u, v
    return f"atan2(sqrt(({b}*{f}-{c}*{e})*({b}*{f}-{c}*{e})+({c}*{d}-{a}*{f})*({c}*{d}-{a}*{f})+({a}*{e}-{b}*{d})*({a}*{e}-{b}*{d})), {a}*{d}+{b}*{e}+{c}*{f})"


@query("pts", "with " + CLOUD + " select src, dst, " + rnd(SIZE, ang(("na", "nb", "nc"), ("a", "b", "c")), ang(("ma", "mb", "mc"), ("a", "b", "c")), ang(("na", "nb", "nc"), ("ma", "mb", "mc"))) + " from d")
def point_pair_features(t):
    return attrs(T.point_pair_features(cloud(t)), 4)


def posed(df, n=3, digits=6):
    return flat(df, "id", col="pos", dim=n, prefix="p", digits=digits)


@query("pts", "with " + CLOUD + " select id, " + ", ".join(f"{rounded_sql(f'{x} - avg({x}) over (partition by g)')} as p{k}" for k, x in enumerate("abc")) + " from p")
def center(t):
    return posed(T.center(cloud(t).nodes, 3, "graph_id"))


@query("pts", "with " + CLOUD + ", q as (select id, g, a-avg(a) over w a, b-avg(b) over w b, c-avg(c) over w c from p window w as (partition by g)), m as (select *, max(greatest(abs(a),abs(b),abs(c))) over (partition by g) m from q) select id, "
       + ", ".join(f"{rounded_sql(f'{x}/m*0.999999')} as p{k}" for k, x in enumerate("abc")) + " from m")
def normalize_scale(t):
    return posed(T.normalize_scale(cloud(t).nodes, 3, "graph_id"))


# rotation keeps every distance: check lengths from the centre
@query("pts", "with " + CLOUD + ", q as (select id, a-avg(a) over w a, b-avg(b) over w b, c-avg(c) over w c from p window w as (partition by g)) select id, " + rounded_sql(SIZE) + " as r from q")
def normalize_rotation(t):
    n = T.normalize_rotation(cloud(t).nodes, 3)
    return n.select("id", rounded(vec.norm2(vec.parts("pos", 3))).alias("r"))


@query("pts", "with " + CLOUD + f" select id, {rounded_sql('a+2*b-c')} as p0, {rounded_sql('0.5*a+c')} as p1, {rounded_sql('b')} as p2 from p")
def linear_transformation(t):
    return posed(T.linear_transformation(cloud(t).nodes, [[1, 2, -1], [.5, 0, 1], [0, 1, 0]]))


@query("pts", "with " + CLOUD + f" select id, {rounded_sql('case when ' + mix.unit_sql('g', seed=4) + ' < 0.5 then -a else a end')} as p0, {rounded_sql('b')} as p1, {rounded_sql('c')} as p2 from p")
def random_flip(t):
    return posed(T.random_flip(cloud(t).nodes, 0, 3, seed=4))


@query("pts", "with " + CLOUD + f", q as (select *, ({mix.unit_sql('g', seed=8)}*60 - 30)*pi()/180 t from p) select id, {rounded_sql('a')} as p0, {rounded_sql('cos(t)*b+sin(t)*c')} as p1, {rounded_sql('-sin(t)*b+cos(t)*c')} as p2 from q")
def random_rotate(t):
    return posed(T.random_rotate(cloud(t).nodes, 30, 0, 3, seed=8))


@query("pts", "with " + CLOUD + f", q as (select *, {mix.unit_sql('g', seed=2)}*0.4 + 0.8 k from p) select id, {rounded_sql('a*k')} as p0, {rounded_sql('b*k')} as p1, {rounded_sql('c*k')} as p2 from q")
def random_scale(t):
    return posed(T.random_scale(cloud(t).nodes, 0.8, 1.2, 3, seed=2))


@query("pts", "with " + CLOUD + " select id, " + ", ".join(
    rounded_sql("+".join("abc"[j] if i == j else f"{'abc'[j]}*({mix.unit_sql('g', seed=20 + i * 3 + j)}*0.4 - 0.2)" for j in range(3))) + f" as p{i}" for i in range(3)) + " from p")
def random_shear(t):
    return posed(T.random_shear(cloud(t).nodes, 0.2, 3, seed=20))


@query("pts", "with " + CLOUD + " select id, " + ", ".join(rounded_sql(f"{x} + ({mix.unit_sql('id', seed=40 + k)}*2-1)*0.05") + f" as p{k}" for k, x in enumerate("abc")) + " from p")
def random_translate(t):
    return posed(T.random_translate(cloud(t).nodes, 0.05, 3, seed=40))


@query("ln", f"select graph_id, id from (select *, row_number() over (partition by graph_id order by {mix.mix_sql('id', seed=6)}, id) r from ln) where r <= 2")
def fixed_points(t):
    return T.fixed_points(t.lines, 2, replace=False, seed=6).select("graph_id", "id")


@query("ln", f"""with r as (select graph_id, id, row_number() over (partition by graph_id order by {mix.mix_sql('id', seed=6)}, id) - 1 as r, count(*) over (partition by graph_id) n from ln),
  s as (select graph_id, n, unnest(range(0, 3)) as slot from (select distinct graph_id, n from r))
  select s.graph_id, s.slot, r.id from s join r on r.graph_id = s.graph_id and r.r = {mix.mix_sql('s.graph_id', 's.slot', seed=7)} % s.n""")
def fixed_points_replaced(t):
    return T.fixed_points(t.lines, 3, seed=6).select("graph_id", "slot", "id")


@query("ln", f"""with r as (select graph_id, id, row_number() over (partition by graph_id order by {mix.mix_sql('id', seed=6)}, id) - 1 as r, count(*) over (partition by graph_id) n from ln),
  s as (select graph_id, n, unnest(range(0, 3)) as slot from (select distinct graph_id, n from r))
  select s.graph_id, s.slot, r.id from s join r on r.graph_id = s.graph_id and r.r = s.slot % s.n""")
def fixed_points_cycled(t):
    return T.fixed_points(t.lines, 3, replace=False, allow_duplicates=True, seed=6).select("graph_id", "slot", "id")


def mesh(t):
    pos = F.array(F.col("x")[0] / 10, F.col("x")[1], (F.col("id") % 5).cast("double"))
    return t.lines.select("id", pos.alias("pos"))


MESH = FACES + """, p as (select id, x0/10 as x, x1 as y, (id % 5)::double as z from ln),
  v as (select face_id, a, b, c, pb.x-pa.x ux, pb.y-pa.y uy, pb.z-pa.z uz, pc.x-pa.x vx, pc.y-pa.y vy, pc.z-pa.z vz from f join p pa on pa.id = a join p pb on pb.id = b join p pc on pc.id = c),
  n as (select *, uy*vz-uz*vy nx, uz*vx-ux*vz ny, ux*vy-uy*vx nz from v), u as (select *, greatest(sqrt(nx*nx+ny*ny+nz*nz),1e-12) r from n)"""


@query("ln", "with " + MESH + """, e as (select a as id, nx/r x, ny/r y, nz/r z from u union all select b, nx/r, ny/r, nz/r from u union all select c, nx/r, ny/r, nz/r from u),
  s as (select id, sum(x) x, sum(y) y, sum(z) z from e group by 1) select l.id, """ + ", ".join(
    rounded_sql(f"coalesce(s.{k}/greatest(sqrt(s.x*s.x+s.y*s.y+s.z*s.z),1e-12),0)") + f" as n{i}" for i, k in enumerate("xyz")) + " from ln l left join s using (id)")
def mesh_normals(t):
    return flat(T.mesh_normals(mesh(t), faces(t)), "id", col="normal", dim=3, prefix="n")


@query("ln", "with " + MESH + ", h as (select face_id, sum(r/2) over (order by face_id rows unbounded preceding) hi, r/2 area from u), t as (select sum(area) total from h), "
       + f"s as (select i as sample, {mix.unit_sql('i', seed=3)} * total as spot from (select unnest(range(0, 2000)) as i), t) select sample, face_id from s join h on spot >= hi - area and spot < hi")
def sample_points(t):
    return T.sample_points(mesh(t), faces(t), 2000, seed=3).select("sample", "face_id")


# diffusion ---------------------------------------------------------------------------------------------

LOOPD = "l as (select src, dst, sum(w) w from (select src, dst, w from le union all select id, id, 1.0 from ln) group by 1, 2), d as (select dst, sum(w) d from l group by 1), t as (select l.src, l.dst, w/sqrt(a.d*b.d) w from l join d a on a.dst = l.src join d b on b.dst = l.dst)"


@query("le ln", "with " + LOOPD + ", t2 as (select a.src, b.dst, sum(a.w*b.w) w from t a join t b on a.dst = b.src group by 1, 2) select src, dst, round(sum(w) + 3.37e-8, 6) as w from (select id as src, id as dst, 0.5 as w from ln union all select src, dst, 0.3*w from t union all select src, dst, 0.2*w from t2) group by 1, 2")
def diffusion_powers(t):
    g = t.b
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    tr = T.transition(T.coalesce_edges(g.edges.unionAll(loops)), "sym")
    return T.diffusion_powers(tr, g.nodes, [0.5, 0.3, 0.2]).select("src", "dst", rounded(F.col("w")).alias("w"))


@query("le ln", "with " + LOOPD + ", t2 as (select a.src, b.dst, sum(a.w*b.w) w from t a join t b on a.dst = b.src group by 1, 2), s as (select src, dst, sum(w) w from (select id as src, id as dst, 0.5 as w from ln union all select src, dst, 0.3*w from t union all select src, dst, 0.2*w from t2) group by 1, 2 having sum(w) >= 0.100003) select src, s.dst, round(w/c + 3.37e-8, 6) as w from s join (select dst, sum(w) c from s group by 1) k on k.dst = s.dst")
def gdc(t):
    return T.gdc(t.line_edges, t.lines, [0.5, 0.3, 0.2], 0.100003).select("src", "dst", rounded(F.col("w")).alias("w"))


@query("sp", "with s as (select src, sum(w) s from sp group by 1) select e.src, dst, round(w/s, 8) as w from sp e join s on s.src = e.src")
def transition_row(t):
    return T.transition(t.sp, "row").select("src", "dst", F.round("w", 8).alias("w"))


@query("sp", "select src, dst, w from (select *, row_number() over (partition by dst order by w desc, src) r from sp) where r <= 3")
def sparsify_top_k(t):
    return T.sparsify_top_k(t.sp, 3)


@query("spu spn", "with n as (select count(*) c from spn), r as (select w, row_number() over (order by w desc, src, dst) - 1 as r from spu) select avg(w) as eps from r, n where r.r in (2*c - 1, 2*c)")
def diffusion_threshold(t):
    eps = T.threshold_for_degree(t.spu, t.sp_nodes, 2)
    return t.sp_nodes.limit(1).select(F.lit(eps).alias("eps"))


@query()
def personalized_pagerank(t):
    from ..operators.edges import add_self_loops
    looped_ = add_self_loops(t.line_edges, t.lines)
    return T.personalized_pagerank_push(looped_, t.lines, 0.3, 2e-2).select("src", "dst", F.round("w", 6).alias("w"))


# the symmetric Laplacian of a bipartite graph has largest eigenvalue exactly 2
@query("", "select 2.0::double as lambda_max")
def laplacian_lambda_max(t):
    from ..operators.reduce import get_laplacian
    lap = get_laplacian(t.spu, t.sp_nodes, "sym")
    value = T.largest_eigenvalue(lap, t.sp_nodes)
    return t.sp_nodes.limit(1).select(F.round(F.lit(value), 4).alias("lambda_max"))


# dense-batch layers ----------------------------------------------------------------------------------------

ROWSUM = "select src, dst, w from le where src <> dst union all select id, id, {v} from ln"


@query("le ln", "with a as (" + ROWSUM.format(v="1.0") + "), d as (select src, 1/sqrt(greatest(sum(w),1)) r from a group by 1), "
       + f"h as (select n.id, r*{lin('x0,x1', W, 0)} a, r*{lin('x0,x1', W, 1)} b from ln n join d on d.src = n.id), s as (select e.src, sum(w*h.a) a, sum(w*h.b) b from a e join h on h.id = e.dst group by 1) select s.src as id, "
       + rnd(f"r*a + ({B[0]})", f"r*b + ({B[1]})") + " from s join d on d.src = s.src")
def dense_gcn_conv(t):
    return out(D.dense_gcn_conv(t.b, W, B))


DSUM = "s as (select n.id, n.x0, n.x1, coalesce(a,0) a, coalesce(b,0) b, coalesce(d,0) d from ln n left join (select src, sum(w*m.x0) a, sum(w*m.x1) b, sum(w) d from le join ln m on m.id = dst group by 1) q on q.src = n.id)"


@query("le ln", "with " + DSUM + " select id, " + rnd(*[lin("a+1.2*x0,b+1.2*x1", W, k) for k in (0, 1)], digits=4) + " from s")
def dense_gin_conv(t):
    return out(D.dense_gin_conv(t.b, lambda v: vec.linear(v, W), 0.2), 4)


@query("le ln", "with " + DSUM + ", h as (select id, x0, x1, a/greatest(d,1) a, b/greatest(d,1) b from s) select id, " + rnd(*[lin("a,b", W, k) + "+" + lin("x0,x1", V, k) for k in (0, 1)]) + " from h")
def dense_graph_conv_mean(t):
    return out(D.dense_graph_conv(t.b, W, V, "mean"))


@query("le ln", "with " + DSUM + ", m as (select id, x0, x1, greatest(a,b) g from s) select id, " + rnd(*[lin("g,g", W, k) + "+" + lin("x0,x1", V, k) for k in (0, 1)], digits=4) + " from m")
def dense_graph_conv_max(t):
    return out(D.dense_graph_conv(t.b, W, V, "max"), 4)


@query("le ln", "with " + DSUM + ", h as (select id, x0, x1, a/greatest(d,1) a, b/greatest(d,1) b from s), o as (select id, " + ", ".join(f"{lin('a,b', W, k)} + {lin('x0,x1', V, k)} as o{k}" for k in (0, 1)) + " from h) select id, " + rnd("o0/greatest(sqrt(o0*o0+o1*o1),1e-12)", "o1/greatest(sqrt(o0*o0+o1*o1),1e-12)") + " from o")
def dense_sage_conv(t):
    return out(D.dense_sage_conv(t.b, W, V, True))


ASSIGN = "s as (select graph_id, id, x0, x1, 1/(1+exp(-(0.02*x0 - 0.1*x1))) as p from ln)"
SAS = "z as (select a.graph_id, sum(w*a.p*b.p) c00, sum(w*a.p*(1-b.p)) c01, sum(w*(1-a.p)*b.p) c10, sum(w*(1-a.p)*(1-b.p)) c11 from le join s a on a.id = src join s b on b.id = dst group by 1)"


def assigned(t):
    return Graph(t.lines.withColumn("s", F.array(F.col("x")[0] * 0.02 - F.col("x")[1] * 0.1, F.lit(0.0))), t.line_edges, 2)


@query("le ln", "with " + ASSIGN + ", " + SAS + ", y as (select graph_id, sum(p*x0) a, sum((1-p)*x0) b from s group by 1) select y.graph_id, "
       + rnd("a", "b", "coalesce(c00,0)", "coalesce(c01,0)", digits=4) + " from y left join z using (graph_id)")
def diff_pool(t):
    got, _ = D.diff_pool(assigned(t), 2)
    cols = [F.col("x")[0], F.col("x")[2], F.col("adj")[0], F.col("adj")[1]]
    return got.select("graph_id", *[rounded(c, 4).alias(f"o{k}") for k, c in enumerate(cols)])


@query("le ln", "with " + ASSIGN + """, m as (select max(n) n, count(*) g from (select count(*) n from ln group by graph_id)),
  pairs as (select a.id as i, b.id as j, a.p*b.p + (1-a.p)*(1-b.p) v from s a join s b on a.graph_id = b.graph_id),
  cells as (select src, dst, sum(w) w from le group by 1, 2),
  l as (select sum((coalesce(w,0)-v)*(coalesce(w,0)-v)) q from pairs left join cells on src = i and dst = j),
  e as (select sum(-p*ln(p+1e-15) - (1-p)*ln(1-p+1e-15)) e from s)
  select round(sqrt(q)/(g*n*n), 8) as link_loss, round(e/(g*n), 6) as ent_loss from l, e, m""")
def diff_pool_losses(t):
    _, losses = D.diff_pool(assigned(t), 2)
    return losses.select(F.round("link_loss", 8).alias("link_loss"), F.round("ent_loss", 6).alias("ent_loss"))


@query("le ln", "with " + ASSIGN + ", " + SAS + " select graph_id, " + rnd("c01/(sqrt(c10)+1e-15)/(sqrt(c01)+1e-15)") + " from z")
def mincut_pool(t):
    got, _ = D.mincut_pool(assigned(t), 2)
    return got.select("graph_id", rounded(F.col("adj")[1]).alias("o0"))


@query("le ln", "with " + ASSIGN + ", " + SAS + """, g as (select src, sum(w) d from le group by 1),
  u as (select graph_id, sum(coalesce(d,0)*(p*p+(1-p)*(1-p))) den, sum(p*p) a, sum(p*(1-p)) b, sum((1-p)*(1-p)) c from s left join g on g.src = s.id group by 1),
  f as (select *, sqrt(a*a+2*b*b+c*c) r from u join z using (graph_id))
  select round(avg(-(c00+c11)/den), 6) as mincut_loss, round(avg(sqrt((a/r-1/sqrt(2))*(a/r-1/sqrt(2)) + 2*(b/r)*(b/r) + (c/r-1/sqrt(2))*(c/r-1/sqrt(2)))), 6) as ortho_loss from f""")
def mincut_pool_losses(t):
    _, losses = D.mincut_pool(assigned(t), 2)
    return losses.select(F.round("mincut_loss", 6).alias("mincut_loss"), F.round("ortho_loss", 6).alias("ortho_loss"))
