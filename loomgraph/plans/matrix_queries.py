"""Matrix algebra, structure features and checks on the supplier x part quantity matrix."""
from pyspark.sql import functions as F

from ..functions import scalar as FN
from ..operators import matrix as X
from .catalog import query
from .reduce_queries import rounded, rounded_sql

def sq(t):
    """square matrix over suppliers: parts folded onto as many columns as there are suppliers"""
    n = t.read("supplier").agg(F.max("s_suppkey") + 1).first()[0]
    return X.sum_duplicates(t.m.withColumn("j", F.col("j") % n))


SQR = "n as (select max(s_suppkey) + 1 as n from supplier), q as (select i, j % n as j, sum(v) as v from m, n group by 1, 2)"


@query("m", "select count(*) as nnz from m")
def nnz(t):
    return X.nnz(t.m)


@query("m", "select max(s) as norm from (select sum(abs(v)) s from m group by i)")
def norm_inf(t):
    return X.norm(t.m, "inf")


@query("m", "select max(s) as norm from (select sum(abs(v)) s from m group by j)")
def norm_one(t):
    return X.norm(t.m, "1")


@query("m", "select round(sqrt(sum(v*v)), 6) as norm from m")
def norm_two(t):
    return X.norm(t.m, "2").select(F.round("norm", 6).alias("norm"))


@query("m", "select round(sqrt(max(s)), 6) as norm from (select sum(v*v) s from m group by j)")
def max_col_norm(t):
    return X.max_col_norm(t.m).select(F.round("norm", 6).alias("norm"))


@query("m", "select round(20*((select count(*) from supplier)+(select count(*) from part))*2.220446049250313e-16*sqrt(max(s))*1e9, 6) as tol from (select sum(v*v) s from m group by j)")
def rank_tolerance(t):
    return X.rank_tolerance(t.m, t.read("supplier").count(), t.read("part").count()).select(F.round(F.col("tol") * 1e9, 6).alias("tol"))


@query("m", "select j as i, i as j, v from m")
def transpose(t):
    return X.transpose(t.m)


PERM = "p as (select s_suppkey as id, row_number() over (order by s_acctbal, s_suppkey) - 1 as pos from supplier)"


def perm(t):
    from ..core.ranges import global_index
    s = t.read("supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return global_index(s, [F.col("s_acctbal"), F.col("id")], "pos").select("id", "pos")


@query("m", "with " + PERM + " select j as i, p.pos as j, v from m join p on p.id = m.i where j % 3 = 0")
def ptranspose(t):
    return X.ptranspose(t.m, perm(t), t.read("part").select(F.col("p_partkey").alias("id")).filter("id % 3 = 0"))


@query("m", "with " + SQR + ", " + PERM + ", u as (select a.pos i, b.pos j, v from q join p a on a.id = q.i join p b on b.id = q.j where q.i <= q.j) select greatest(i,j) as i, least(i,j) as j, v from u")
def ptranspose_symmetric(t):
    return X.ptranspose_symmetric(X.triangle(sq(t)), perm(t))


@query("m", "with " + SQR + ", " + PERM + " select a.pos as i, b.pos as j, v from q join p a on a.id = q.i join p b on b.id = q.j")
def permute(t):
    return X.permute(sq(t), perm(t), perm(t))


@query("m", "with " + SQR + " select i, j, sum(v) as v from (select i, j, 2.0*v as v from q union all select j, i, -0.5*v from q) group by 1, 2")
def matrix_add(t):
    a = sq(t)
    return X.add(a, X.transpose(a), 2.0, -0.5)


@query("m", "with " + SQR + " select i, j, v from q where j - i between -3 and 5")
def band(t):
    return X.band(sq(t), -3, 5)


@query("m", "with " + SQR + " select i, j from q where j - i between -3 and 5 and i <> j")
def band_pattern(t):
    return X.band(sq(t), -3, 5, -1)


@query("m", "with " + SQR + ", u as (select i, j, v from q where i <= j) select i, j, v from u union all select j, i, v from u where i <> j")
def copy_symmetric(t):
    return X.symmetric_half_to_full(X.triangle(sq(t)))


@query("", "select l_suppkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by 1, 2")
def triplet_to_sparse(t):
    return X.sum_duplicates(t.read("lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")))


@query("m", "select i, sum(v * p_size) as v from m join part on p_partkey = j group by 1")
def spmv(t):
    x = t.read("part").select(F.col("p_partkey").alias("i"), F.lit(0).alias("c"), F.col("p_size").cast("double").alias("v"))
    return X.sdmult(t.m, x).select("i", "v")


@query("m", "select j as i, sum(v) as v from (select j, 2.0*v*s_nationkey as v from m join supplier on s_suppkey = i union all select p_partkey, 3.0*p_size from part) group by 1")
def spmv_transposed(t):
    x = t.read("supplier").select(F.col("s_suppkey").alias("i"), F.lit(0).alias("c"), F.col("s_nationkey").cast("double").alias("v"))
    y = t.read("part").select(F.col("p_partkey").alias("i"), F.lit(0).alias("c"), F.col("p_size").cast("double").alias("v"))
    return X.sdmult(t.m, x, y, 2.0, 3.0, True).select("i", "v")


@query("m", "select a.i, b.i as j, sum(a.v*b.v) as v from m a join m b using (j) group by 1, 2")
def aat(t):
    return X.aat(t.m)


@query("m", "select distinct a.i, b.i as j from m a join m b using (j) where j % 2 = 0 and a.i <> b.i")
def aat_pattern(t):
    return X.aat(t.m, t.read("part").select(F.col("p_partkey").alias("id")).filter("id % 2 = 0"), -1)


@query("m", "select i, sum(v) as s from m group by 1")
def row_sums(t):
    return X.sums(t.m)


@query("m", "select j, sum(v*v) as s from m group by 1")
def col_squared_norms(t):
    return X.sums(t.m, "j", True)


@query("m", "select j, (coalesce(sum(c) over (order by j rows between unbounded preceding and 1 preceding), 0))::bigint as p from (select j, count(*) c from m group by 1)")
def prefix_sum(t):
    return X.prefix_sum(t.m.groupBy("j").agg(F.count("*").alias("c")), "j", "c")


@query("m", "with " + SQR + """, o as (select distinct i, j from q where i <> j), s as (select count(*) c from o a join o b on a.i = b.j and a.j = b.i)
  select s.c as matched, (select count(*) from o) as "off", (select count(*) from q where i = j) as diag, round(s.c / (select count(*) from o), 8) as symmetry from s""")
def symmetry(t):
    return X.symmetry(sq(t).filter("v > 0")).withColumn("symmetry", F.round("symmetry", 8))


@query("m", "with " + SQR + " select i as src, j as dst from q where i <> j union select j, i from q where i <> j")
def pattern_of_sum(t):
    return X.pattern_of_sum(sq(t))


@query("m", "with d as (select i, unnest(range(0, 3)) as j from (select distinct i from m)) select d.i, d.j, coalesce(m.v, 0) as v from d left join m on m.i = d.i and m.j = d.j")
def sparse_to_dense(t):
    rows = X.to_dense(t.m, t.read("supplier").count(), t.read("part").count())
    return rows.select("i", F.posexplode(F.slice("row", 1, 3)).alias("j", "v")).withColumn("j", F.col("j").cast("bigint"))


@query("m", "select i, j, v from m where v > 30")
def drop_zeros(t):
    return X.drop_zeros(t.m.withColumn("v", F.when(F.col("v") > 30, F.col("v")).otherwise(0.0)))


# structure of many small matrices: one per order, entries between lines plus some diagonals -------------

ENT = "a as (select l.graph_id, e.src as i, e.dst as j from le e join ln l on l.id = e.src where e.w > 8 or e.src < e.dst union all select graph_id, id, id from ln where y < 2)"


def entries(t):
    n = t.lines.select(F.col("id").alias("src"), "graph_id")
    off = t.line_edges.join(n, "src").filter("w > 8 or src < dst").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    return off.unionAll(t.lines.filter("y < 2").select("graph_id", F.col("id").alias("i"), F.col("id").alias("j")))


FEAT = ENT + """, r as (select i, count(*) c from a where i <> j group by 1), c as (select j, count(*) c from a where i <> j group by 1),
  s as (select x.j as k, count(*) c from a x join a y on y.i = x.j join a z on z.i = x.i and z.j = y.j where x.i <> x.j and y.i <> y.j group by 1),
  f as (select graph_id, id, coalesce(r.c,0) as rdeg, coalesce(c.c,0) as cdeg, coalesce(r.c,0)*coalesce(c.c,0)-coalesce(s.c,0) as eli_add
  from ln left join r on r.i = id left join c on c.j = id left join s on s.k = id)"""


@query("le ln", "with " + FEAT + " select * from f")
def node_features(t):
    return X.node_features(entries(t), t.lines)


@query("le ln", "with " + FEAT + """, g as (select graph_id, count(*) n, sum(rdeg) s, max(rdeg) mr, max(cdeg) mc, least(min(rdeg),999) lr, least(min(cdeg),999) lc from f group by 1),
  h as (select graph_id, count(*) filter (where rdeg = mr) a, count(*) filter (where cdeg = mc) b from f join g using (graph_id) group by 1), z as (select graph_id, count(*) nnz from a group by 1)
  select graph_id, n, nnz, round(nnz/(n*n), 8) as density, round(s/n, 8) as avg_rdeg, round(a/n, 8) as max_rdeg_share, round(b/n, 8) as max_cdeg_share,
  mr as max_rdeg, lr as min_rdeg, mc as max_cdeg, lc as min_cdeg from g join h using (graph_id) join z using (graph_id)""")
def graph_info(t):
    e = entries(t)
    g = X.graph_info(e, X.node_features(e, t.lines))
    return g.select(*[F.round(c, 8).alias(c) if c in ("density", "avg_rdeg", "max_rdeg_share", "max_cdeg_share") else F.col(c) for c in g.columns])


@query("le ln", "with " + FEAT + """ select graph_id, id, round(rdeg/(max(rdeg) over w + 1), 8) as rdeg, round(cdeg/(max(cdeg) over w + 1), 8) as cdeg,
  round(eli_add/(max(eli_add) over w + 1), 8) as eli_add from f window w as (partition by graph_id)""")
def scaled_features(t):
    s = X.scaled_features(X.node_features(entries(t), t.lines))
    return s.select("graph_id", "id", *[F.round(c, 8).alias(c) for c in ("rdeg", "cdeg", "eli_add")])


# checks -------------------------------------------------------------------------------------------------------

@query("", """select count(*) filter (where l_suppkey >= 90 or l_partkey >= 2000) as out_of_range, 0::bigint as bad_values,
  (count(*) - count(distinct (l_suppkey, l_partkey)))::bigint as duplicates from lineitem""")
def check_sparse(t):
    raw = t.read("lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return X.check_sparse(raw, 90, 2000)


@query("", """select count(*) filter (where id >= 90) as out_of_range, coalesce(sum(c-1),0)::bigint as repeated, (90 - count(*))::bigint as missing from
  (select l_suppkey as id, count(*) c from lineitem where l_quantity = 50 and l_discount = 0 group by 1)""")
def check_perm(t):
    p = t.read("lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_suppkey").alias("id"))
    return X.check_perm(p, 90).select("out_of_range", "repeated", F.col("missing").cast("bigint").alias("missing"))


@query("", "select count(*) filter (where s_suppkey >= 80) as out_of_range from supplier")
def check_subset(t):
    return X.check_subset(t.read("supplier").select(F.col("s_suppkey").alias("id")), 80)


@query("", "select count(*) filter (where c_nationkey <= c_custkey) as not_after from customer")
def check_parent(t):
    return X.check_parent(t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent")))


@query("m", "with l as (select i, j, v from m where i >= j) select 0::bigint as above_diagonal, ((select count(*) from supplier) - (select count(*) from l where i = j))::bigint as bad_diagonal")
def check_factor(t):
    n = t.read("supplier").count()
    return X.check_factor(t.m.filter("i >= j"), n).select("above_diagonal", F.col("bad_diagonal").cast("bigint").alias("bad_diagonal"))


@query("m", "select round(pow(min(v)/max(v), 2), 8) as rcond from m where i = j")
def rcond(t):
    return X.rcond(t.m).select(F.round("rcond", 8).alias("rcond"))


@query("m", "with d as (select j, sqrt(v) r from m where i = j) select i, m.j, round(case when i = m.j then r else v*r end, 6) as v from m join d on d.j = m.j")
def change_factor_ldl_to_ll(t):
    return X.ldl_to_ll(t.m).select("i", "j", F.round("v", 6).alias("v"))


@query("m", "with d as (select j, v r from m where i = j) select i, m.j, round(case when i = m.j then r*r else v/r end, 6) as v from m join d on d.j = m.j")
def change_factor_ll_to_ldl(t):
    return X.ll_to_ldl(t.m).select("i", "j", F.round("v", 6).alias("v"))


# scalar functions over real columns ----------------------------------------------------------------------------

LI = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, {} from lineitem"


def scalars(t, **cols):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[rounded(c).alias(n) for n, c in cols.items()])


def real():
    return F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")


@query("", LI.format(rounded_sql("sqrt(l_quantity*l_quantity + l_discount*l_discount)") + " as h"))
def hypot(t):
    q, d, _ = real()
    return scalars(t, h=X.hypot(q, d))


@query("", LI.format(rounded_sql("(l_quantity*(l_tax+1) + l_discount*l_discount)/((l_tax+1)*(l_tax+1)+l_discount*l_discount)") + " as re, "
                     + rounded_sql("(l_discount*(l_tax+1) - l_quantity*l_discount)/((l_tax+1)*(l_tax+1)+l_discount*l_discount)") + " as im"))
def divide_complex(t):
    q, d, tax = real()
    z = X.divide_complex(q, d, tax + 1, d)
    return scalars(t, re=z["re"], im=z["im"])


@query("", LI.format(", ".join(rounded_sql(e) + f" as {n}" for n, e in {
    "swish": "l_discount/(1+exp(-l_discount))", "ssp": "ln(1+exp(l_discount)) - ln(2)",
    "time": "cos(0.5*l_quantity+0.1)", "rbf": "exp(-0.5/((5.0/49)*(5.0/49))*(l_discount*20-5.0/49*3)*(l_discount*20-5.0/49*3))",
    "env": "1/((l_discount+0.1)) - 28*pow(l_discount+0.1,5) + 48*pow(l_discount+0.1,6) - 21*pow(l_discount+0.1,7)",
    "bessel": "(1/((l_discount+0.1)) - 28*pow(l_discount+0.1,5) + 48*pow(l_discount+0.1,6) - 21*pow(l_discount+0.1,7))*sin(2*pi()*(l_discount+0.1))"}.items())))
def scalar_functions(t):
    q, d, _ = real()
    u = d + 0.1
    return scalars(t, swish=FN.swish(d), ssp=FN.shifted_softplus(d), time=FN.time_encoding(q, [0.5], [0.1])[0],
                   rbf=FN.gaussian_smearing(d * 20, 0.0, 5.0, 50)[3], env=FN.envelope(u, 5), bessel=FN.bessel_basis(u * 5, 2, 5.0, 5)[1])


@query()
def spherical_basis(t):
    """radial spherical Bessel functions times zonal harmonics, three orders and two roots"""
    q, d, _ = real()
    b = FN.spherical_basis(d + 0.1, q / 20, 3, 2, 5)
    return scalars(t, **{f"s{k}": c for k, c in enumerate(b)})
