"""Orders, symbolic analysis, QR and Cholesky, checked by identities the SQL can state."""
from pyspark.sql import functions as F

from ..core.session import cut
from ..operators import elimination as E
from ..operators import factor as X
from ..operators.edges import both_ways
from .catalog import query


def tree_edges(t):
    """customer - nation - region hierarchy as one forest: ids 3c, 3n+1, 3r+2"""
    c = t.read("customer").select((F.col("c_custkey") * 3).alias("src"), (F.col("c_nationkey").cast("bigint") * 3 + 1).alias("dst"))
    n = t.read("nation").select((F.col("n_nationkey").cast("bigint") * 3 + 1).alias("src"), (F.col("n_regionkey").cast("bigint") * 3 + 2).alias("dst"))
    return both_ways(c.unionAll(n))


def ids_of(edges):
    return edges.select(F.col("src").alias("id")).distinct()


# a forest loses nothing under minimum degree: one entry per edge plus the diagonal
@query("", "with n as (select 3*c_custkey as id from customer union select 3*n_nationkey::bigint+1 from nation union select 3*n_regionkey::bigint+2 from nation) select (select count(*) from n) + (select count(*) from customer) + (select count(*) from nation) as lnz")
def minimum_degree_forest(t):
    e = tree_edges(t)
    return E.minimum_degree(e, ids_of(e)).totals().select("lnz")


@query("ln", "select count(*) as n, count(*) - 1 as last from ln")
def minimum_degree_order(t):
    o = E.minimum_degree(t.line_edges, t.lines).order()
    return o.agg(F.count_distinct("id").alias("n"), F.max("pos").alias("last"))


@query()
def minimum_degree_counts(t):
    return E.minimum_degree(t.spu, t.sp_nodes).column_counts()


# the order-line band (each line tied to the next two) has a known fill in its natural order
NAT = """with p as (select id, graph_id from ln), e as (select src, dst from le where src < dst),
  r1 as (select e1.dst as i, e2.dst as j from e e1 join e e2 on e1.src = e2.src where e1.dst < e2.dst), f1 as (select i, j from r1 union select src, dst from e),
  r2 as (select a.j as i, b.j as j from f1 a join f1 b on a.i = b.i where a.j < b.j), f2 as (select i, j from r2 union select i, j from f1),
  r3 as (select a.j as i, b.j as j from f2 a join f2 b on a.i = b.i where a.j < b.j), f3 as (select i, j from r3 union select i, j from f2),
  r4 as (select a.j as i, b.j as j from f3 a join f3 b on a.i = b.i where a.j < b.j), f4 as (select i, j from r4 union select i, j from f3)"""


def natural(t):
    return E.symbolic_of_order(t.line_edges, t.lines.select("id", F.col("id").alias("pos")))


@query("le ln", NAT + " select i as j, j as i from f4")
def factor_pattern(t):
    return natural(t).pattern()


# entries of weight above 20 are lost; the refreshed pattern is that of a fresh analysis
@query("le ln", NAT.replace("where src < dst)", "where src < dst and w <= 20)", 1) + " select i as j, j as i from f4")
def refreshed_pattern(t):
    e = cut(t.line_edges)
    order = t.lines.select("id", F.col("id").alias("pos"))
    lost = e.filter((F.col("w") > 20) & (F.col("src") < F.col("dst"))).select(F.col("src").alias("id"))
    return E.refreshed_pattern(natural(t).pattern(), order, e.filter("w <= 20"), lost)


@query("le ln", NAT + " select p.id, 1 + count(f4.j) as count from p left join f4 on f4.i = p.id group by 1")
def column_counts(t):
    return natural(t).column_counts()


@query("le ln", NAT + " select p.id, coalesce(min(f4.j), -1) as parent from p left join f4 on f4.i = p.id group by 1")
def elimination_tree(t):
    return natural(t).etree()


@query("le ln", NAT + ", c as (select p.id, 1 + count(f4.j) as n from p left join f4 on f4.i = p.id group by 1) select sum(n)::bigint as lnz, sum(n*n)::bigint as work from c")
def fill_in(t):
    return natural(t).totals()


@query("le ln", NAT + " select j as i, i as j from f4 join ln on ln.id = f4.j where ln.y = 1")
def row_subtree(t):
    return natural(t).row_pattern(t.lines.filter("y = 1"))


@query("le ln", NAT.replace("with p", "with recursive p", 1) + ", t as (select p.id, min(f4.j) as parent from p left join f4 on f4.i = p.id group by 1), r as (select id from ln where y = 2 union select t.parent from r join t on t.id = r.id where t.parent is not null) select id from r")
def solve_pattern(t):
    return E.reach_up(cut(natural(t).etree()), t.lines.filter("y = 2"))


@query()
def fronts(t):
    return natural(t).fronts()


# tree rooted at regions: postorder by recursive path sort
POST = """with recursive t as (select 3*c_custkey as id, 3*c_nationkey+1 as parent from customer union all select 3*n_nationkey+1, 3*n_regionkey+2 from nation union all select 3*r_regionkey+2, -1 from region),
  w as (select id, [id::bigint] as path from t where parent = -1 union all select t.id, list_append(path, t.id::bigint) from w join t on t.parent = w.id)
  select id, row_number() over (order by list_append(path, 999999999999999)) - 1 as post from w"""


@query("", POST)
def postorder(t):
    c = t.read("customer").select((F.col("c_custkey") * 3).alias("id"), (F.col("c_nationkey").cast("bigint") * 3 + 1).alias("parent"))
    n = t.read("nation").select((F.col("n_nationkey").cast("bigint") * 3 + 1).alias("id"), (F.col("n_regionkey").cast("bigint") * 3 + 2).alias("parent"))
    r = t.read("region").select((F.col("r_regionkey").cast("bigint") * 3 + 2).alias("id"), F.lit(-1).cast("bigint").alias("parent"))
    return E.postorder(c.unionAll(n).unionAll(r))


@query("spn", "select count(*) as n from spn")
def column_minimum_degree(t):
    """columns of the part x supplier matrix, and of its transpose"""
    a = E.column_minimum_degree(t.m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).order()
    b = E.column_minimum_degree(t.m).order()
    return a.unionAll(b).agg(F.count("*").alias("n"))


@query()
def constrained_minimum_degree(t):
    return E.constrained_minimum_degree(t.line_edges, t.lines.select("id", (F.col("y") % 2).alias("cls"))).order()


# class 1 columns come last wherever the two classes meet: no class-1 column precedes a linked class-0 one
@query("", "select 0::bigint as wrong")
def constrained_order_respected(t):
    cls = t.lines.select("id", (F.col("y") % 2).alias("cls"))
    o = cut(E.constrained_minimum_degree(t.line_edges, cls).order().join(cls, "id"))
    a, b = o.select(F.col("id").alias("src"), F.col("pos").alias("p"), F.col("cls").alias("c")), o.select(F.col("id").alias("dst"), F.col("pos").alias("q"), F.col("cls").alias("d"))
    return t.line_edges.join(a, "src").join(b, "dst").agg(F.count_if((F.col("c") < F.col("d")) & (F.col("p") > F.col("q"))).alias("wrong"))


# no edge joins the two sides of any dissected piece
@query("ln", "select count(*) as placed, 0::bigint as crossing from ln")
def nested_dissection_classes(t):
    c = cut(E.dissection_classes(t.line_edges, t.lines, 2))
    leaf = c.filter("cls = 0")
    bad = t.line_edges.join(leaf.select(F.col("id").alias("src"), F.col("piece").alias("a")), "src").join(
        leaf.select(F.col("id").alias("dst"), F.col("piece").alias("b")), "dst").agg(F.count_if(F.col("a") != F.col("b")).alias("crossing"))
    return c.agg(F.count("*").alias("placed")).crossJoin(bad)


@query()
def nested_dissection(t):
    e = tree_edges(t)
    return E.nested_dissection(e, ids_of(e)).order()


# customers of the orders filed in a heap-numbered tree of 127 nodes: subtrees below 400 members, or with half of them on top, are one
FILED = "o as (select o_orderkey as id, 1 + (o_custkey + o_orderkey) % 127 as node from orders)"


@query("", f"with {FILED}, a as (select distinct node, node >> d as above from o, range(7) r(d) where node >> d > 0), z as (select above as node, count(*) filter (o.node = above) as n, count(*) as total from o join a using (node) group by 1), w as (select node from z where total < 400 or n >= 0.5 * total), m as (select a.node, min(above) as top from a join w on w.node = a.above group by 1) select id, coalesce(top, o.node) as node from o left join m using (node)")
def collapsed_separators(t):
    member = t.read("orders").select(F.col("o_orderkey").alias("id"), (1 + (F.col("o_custkey") + F.col("o_orderkey")) % 127).alias("node"))
    return E.collapse_separators(member, 0.5, 400)


@query()
def best_order(t):
    e = tree_edges(t)
    name, _, tried = E.best_order(e, ids_of(e), 1)
    rows = e.limit(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.lit(v).alias("lnz"), F.lit(k == name).alias("chosen")) for k, v in tried.items()])).alias("r"))
    return rows.select("r.*")


SING = "a as (select o_orderkey as i, o_custkey as j, o_totalprice as v from orders)"


@query("", "with " + SING + ", s as (select j, min(i) i from a group by 1 having count(*) = 1) select j, i, 0 as round from s")
def column_singletons(t):
    """customers with one order, then whatever peeling frees"""
    a = t.read("orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j"), F.col("o_totalprice").alias("v"))
    return E.column_singletons(a)


# QR: R'R must equal A'A -----------------------------------------------------------------------------------

def pm(t):
    """part x supplier matrix"""
    return t.m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


@query("m", "select a.i, b.i as j, round(sum(a.v*b.v), 2) as v from m a join m b using (j) group by 1, 2")
def qr_gram(t):
    r = X.qr_factor(pm(t)).r.select("row_id", "col", "v")
    return r.select("row_id", F.col("col").alias("i"), "v").join(r.select("row_id", F.col("col").alias("j"), F.col("v").alias("w")), "row_id").groupBy("i", "j").agg(
        F.round(F.sum(F.col("v") * F.col("w")), 2).alias("v"))


def gram_times(a, x):
    ax = a.join(x.select(F.col("id").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return a.join(ax, "i").groupBy(F.col("j").alias("id")).agg(F.round(F.sum(F.col("v") * F.col("y")), 2).alias("v"))


# least squares x: A'A x = A'b
@query("m", "select i as id, round(sum(v*p_size), 2) as v from m join part on p_partkey = j group by 1")
def qr_least_squares(t):
    a = pm(t)
    b = t.read("part").select(F.col("p_partkey").alias("i"), F.lit(0).cast("bigint").alias("c"), F.col("p_size").cast("double").alias("v"))
    return gram_times(a, cut(X.least_squares(a, b)))


# many small problems at once: order lines on their neighbours
@query("le ln", "select e.dst as id, round(sum(e.w * b.x0), 2) as v from le e join ln b on b.id = e.src group by 1")
def qr_least_squares_batch(t):
    a = t.line_edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    b = t.lines.select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("c"), F.col("x")[0].alias("v"))
    return gram_times(a, cut(X.least_squares(a, b, tol=1e-9)))


# Q (Q'b) is the part of b the columns explain: A' (Q Q'b) = A'b
@query("m", "select i as id, round(sum(v*p_size), 2) as v from m join part on p_partkey = j group by 1")
def qr_apply_q(t):
    a = pm(t)
    b = t.read("part").select(F.col("p_partkey").alias("i"), F.lit(0).cast("bigint").alias("c"), F.col("p_size").cast("double").alias("v"))
    f = X.qr_factor(a, rhs=b)
    qb = X.apply_q(a, f, f.qtb)
    return a.join(qb.select("i", F.col("v").alias("y")), "i").groupBy(F.col("j").alias("id")).agg(F.round(F.sum(F.col("v") * F.col("y")), 2).alias("v"))


@query("", "with d as (select distinct l_suppkey from lineitem) select count(*) as rank, count(*) as dead from d")
def qr_rank(t):
    """every column twice: half of them must come out dead"""
    a = pm(t)
    n = t.read("supplier").agg(F.max("s_suppkey") + 1).first()[0]
    twin = a.unionAll(a.select("i", (F.col("j") + n).alias("j"), "v"))
    f = X.qr_factor(twin, tol=1e-6)
    return f.r.agg(F.count_distinct("row_id").alias("rank")).crossJoin(f.dead.agg(F.count("*").alias("dead")))


# Cholesky of Laplacian + I: L L' must give the matrix back -----------------------------------------------------

SHIFT = "s as (select i, j, sum(v) v from (select src as i, dst as j, -w as v from le union all select src, src, w from le union all select id, id, 1.0 from ln) group by 1, 2)"


def shifted(t):
    e = t.line_edges
    parts = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v")).unionAll(
        e.select(F.col("src").alias("i"), F.col("src").alias("j"), F.col("w").alias("v"))).unionAll(
        t.lines.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


@query("le ln", "with " + SHIFT + " select i, j, round(v, 4) as v from s where abs(v) > 1e-6")
def cholesky_product(t):
    l = X.cholesky(shifted(t)).l
    return l.select("i", F.col("j").alias("k"), "v").join(l.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w")), "k").groupBy("i", "j").agg(
        F.round(F.sum(F.col("v") * F.col("w")), 4).alias("v")).filter(F.abs("v") > 1e-6)


@query("ln", "select id, round(x0, 4) as v from ln")
def cholesky_solve(t):
    a = cut(shifted(t))
    x = X.chol_solve(X.cholesky(a), t.lines.select("id", F.col("x")[0].alias("v")))
    return a.join(x.select(F.col("id").alias("j"), F.col("v").alias("x")), "j").groupBy(F.col("i").alias("id")).agg(F.round(F.sum(F.col("v") * F.col("x")), 4).alias("v"))
