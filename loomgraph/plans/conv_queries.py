"""Message-passing layers with fixed weights on the supplier-part and order-line graphs."""
from pyspark.sql import functions as F

from ..core import vec
from ..graph import Graph
from ..operators import conv as C
from .catalog import query
from .reduce_queries import flat, rounded_sql

W = [[0.5, -0.2], [0.1, 0.3]]
V = [[-0.3, 0.4], [0.2, 0.05]]
U = [[0.15, 0.25], [-0.1, 0.35]]
B = [0.1, -0.2]
ATT = [0.6, -0.4]


def lin(cols, m, c, b=None):
    """SQL for one output channel of cols @ m + b"""
    s = " + ".join(f"({x})*({r[c]})" for x, r in zip(cols.split(","), m))
    return f"({s}{'' if b is None else f' + ({b[c]})'})"


def out(df, digits=6, dim=2):
    return flat(df, "id", col="out", dim=dim, digits=digits, prefix="o")


PROP = "(select e.dst as id, sum(e.w*n.x0) s0, sum(e.w*n.x1) s1 from {e} e join {n} n on n.id = e.src group by 1)"


def prop(e, n, name):
    return f"{name} as (select n.id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from {n} n left join {PROP.format(e=e, n=n)} q on q.id = n.id)"


def rnd(*exprs, digits=6, prefix="o"):
    return ", ".join(f"{rounded_sql(e, digits)} as {prefix}{k}" for k, e in enumerate(exprs))


@query("gcn spn", f"with {prop('gcn', 'spn', 'p')} select id, " + rnd(lin("p0,p1", W, 0, B), lin("p0,p1", W, 1, B)) + " from p")
def gcn_conv(t):
    return out(C.gcn_conv(t.g, W, B))


@query("spu spn", f"with {prop('spu', 'spn', 'p')} select id, " + rnd(
    lin("p0,p1", W, 0, B) + "+" + lin("x0,x1", V, 0), lin("p0,p1", W, 1, B) + "+" + lin("x0,x1", V, 1), digits=4) + " from p")
def graph_conv(t):
    return out(C.graph_conv(t.g, W, V, B), 4)


MEAN = """p as (select n.id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from spn n left join
  (select e.dst as id, avg(m.x0) s0, avg(m.x1) s1 from spu e join spn m on m.id = e.src group by 1) q on q.id = n.id)"""
SAGE = [lin("p0,p1", W, k, B) + "+" + lin("x0,x1", V, k) for k in (0, 1)]


@query("spu spn", f"with {MEAN} select id, " + rnd(*SAGE) + " from p")
def sage_conv(t):
    return out(C.sage_conv(t.g, W, V, B))


@query("spu spn", f"with {MEAN}, q as (select id, {SAGE[0]} a, {SAGE[1]} b from p) select id, " + rnd(
    "a/sqrt(a*a+b*b)", "b/sqrt(a*a+b*b)") + " from q")
def sage_conv_normalized(t):
    return out(C.sage_conv(t.g, W, V, B, normalize=True))


SUM = """p as (select n.id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from {n} n left join
  (select e.dst as id, sum(m.x0) s0, sum(m.x1) s1 from {e} e join {n} m on m.id = e.src group by 1) q on q.id = n.id)"""


@query("le ln", "with " + SUM.format(e="le", n="ln") + ", h as (select id, p0+1.1*x0 a, p1+1.1*x1 b from p) select id, "
       + rnd(*[f"greatest({lin('a,b', W, k, B)}, 0)" for k in (0, 1)]) + " from h")
def gin_conv(t):
    return out(C.gin_conv(t.b, lambda v: [vec.relu(c) for c in vec.linear(v, W, B)], eps=0.1))


@query("le ln", """with p as (select n.id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from ln n left join
  (select e.dst as id, sum(greatest(m.x0-w,0)) s0, sum(greatest(m.x1+w,0)) s1 from le e join ln m on m.id = e.src group by 1) q on q.id = n.id)
  select id, """ + rnd(*[lin("p0+x0,p1+x1", W, k, B) for k in (0, 1)]) + " from p")
def gine_conv(t):
    return out(C.gine_conv(t.b, [-F.col("w"), F.col("w")], lambda v: vec.linear(v, W, B)))


def chain(e, n, steps, each):
    """x_k tables k1..kn: each(p, x, x0) per channel as SQL"""
    ctes = [f"k0 as (select id, x0, x1, x0 as z0, x1 as z1 from {n})"]
    for k in range(1, steps + 1):
        ctes.append(f"""k{k} as (select n.id, {each('coalesce(s0,0)', 'n.x0', 'n.z0')} as x0, {each('coalesce(s1,0)', 'n.x1', 'n.z1')} as x1, n.z0, n.z1
          from k{k-1} n left join (select e.dst as id, sum(e.w*m.x0) s0, sum(e.w*m.x1) s1 from {e} e join k{k-1} m on m.id = e.src group by 1) q on q.id = n.id)""")
    return ", ".join(ctes)


@query("gcn spn", "with " + chain("gcn", "spn", 2, lambda p, x, z: p) + " select id, " + rnd(*[lin("x0,x1", W, k, B) for k in (0, 1)]) + " from k2")
def sg_conv(t):
    return out(C.sg_conv(t.g, W, 2, B))


@query("adj spn", "with " + chain("adj", "spn", 2, lambda p, x, z: p) + " select c.id, " + rnd(*[
    lin("a.x0,a.x1,b.x0,b.x1,c.x0,c.x1", W + V + U, k, B) for k in (0, 1)]) + " from k0 a join k1 b on a.id=b.id join k2 c on c.id=a.id")
def tag_conv(t):
    return out(C.tag_conv(t.g, W + V + U, 2, B))


@query("gcn spn", "with " + chain("gcn", "spn", 4, lambda p, x, z: f"0.9*{p} + 0.1*{z}") + " select id, " + rnd("x0", "x1") + " from k4")
def appnp(t):
    return out(C.appnp(t.g, 4, 0.1))


@query("gcn spn", f"with {prop('gcn', 'spn', 'p')}, h as (select id, 0.8*p0+0.2*x0 a, 0.8*p1+0.2*x1 b from p) select id, "
       + rnd(*[f"0.7*{'ab'[k]} + 0.3*{lin('a,b', W, k)}" for k in (0, 1)]) + " from h")
def gcn2_conv(t):
    return out(C.gcn2_conv(t.g, W, 0.2, 0.3))


# with lambda 2 the scaled symmetric Laplacian is minus the normalised adjacency
@query("adj spn", """with a1 as (select src, dst, -w as w from adj), """ + prop("a1", "spn", "p") + """,
  q as (select p.*, 2*coalesce(s0,0)-x0 q0, 2*coalesce(s1,0)-x1 q1 from p left join
  (select e.dst as id, sum(e.w*n.p0) s0, sum(e.w*n.p1) s1 from a1 e join p n on n.id = e.src group by 1) z on z.id = p.id)
  select id, """ + rnd(*[lin("x0,x1", W, k) + "+" + lin("p0,p1", V, k) + "+" + lin("q0,q1", U, k, B) for k in (0, 1)]) + " from q")
def cheb_conv(t):
    return out(C.cheb_conv(t.g, [W, V, U], b=B))


@query("adj spn", f"with m as (select id, {lin('x0,x1', W, 0)} x0, {lin('x0,x1', W, 1)} x1 from spn), " + prop("adj", "m", "p")
       + ", r as (select n.id, " + ", ".join(f"greatest(p{k} + {lin('n.x0,n.x1', V, k)}, 0) as r{k}" for k in (0, 1))
       + ", n.x0, n.x1 from p join spn n on n.id = p.id), m2 as (select id, " + ", ".join(f"{lin('r0,r1', U, k)} as x{k}" for k in (0, 1))
       + " from r), " + prop("adj", "m2", "p2") + " select p2.id, " + rnd(*[f"greatest(p2.p{k} + {lin('r.x0,r.x1', W, k)}, 0)" for k in (0, 1)])
       + " from p2 join r on r.id = p2.id")
def arma_conv(t):
    return out(C.arma_conv(t.g, [W], [[U]], [[V], [W]], 2))


@query("spu spn", """with l as (select src, dst from spu union all select id, id from spn), d as (select dst, count(*) c from l group by 1),
  e as (select l.src, l.dst, case when l.src = l.dst then 1.5 else 1.0 end / c as w from l join d on d.dst = l.dst), """ + prop("e", "spn", "p")
       + " select id, " + rnd(*[lin("p0,p1", W, k, B) + "+" + lin("x0,x1", V, k) for k in (0, 1)]) + " from p")
def cluster_gcn_conv(t):
    return out(C.cluster_gcn_conv(t.g, W, V, 0.5, B))


@query("spu spn", "with q as (select e.dst as id, " + ", ".join(
    f"sum(w*({lin('i.x0,i.x1', W, k)} - {lin('j.x0,j.x1', V, k)})) s{k}" for k in (0, 1))
       + " from spu e join spn j on j.id = e.src join spn i on i.id = e.dst group by 1) select n.id, "
       + rnd(*[f"coalesce(s{k},0) + {lin('x0,x1', U, k)}" for k in (0, 1)], digits=4) + " from spn n left join q on q.id = n.id")
def le_conv(t):
    return out(C.le_conv(t.g, W, V, U), 4)


@query("le ln", "with " + SUM.format(e="le", n="ln") + ", d as (select p.*, least(coalesce(c,0),2) as d from p left join (select dst, count(*) c from le group by 1) on dst = id) select id, "
       + rnd(*["case d " + " ".join(f"when {r} then {lin('p0,p1', m, k)} + {lin('x0,x1', n, k)}" for r, (m, n) in enumerate([(W, V), (V, U), (U, W)])) + " end"
               for k in (0, 1)]) + " from d")
def mf_conv(t):
    return out(C.mf_conv(t.b, [W, V, U], [V, U, W]))


EC = W + V


@query("le ln", "with q as (select e.dst as id, " + ", ".join(f"max({lin('i.x0,i.x1,j.x0-i.x0,j.x1-i.x1', EC, k)}) s{k}" for k in (0, 1))
       + " from le e join ln j on j.id = e.src join ln i on i.id = e.dst group by 1) select n.id, "
       + rnd("coalesce(s0,0)", "coalesce(s1,0)") + " from ln n left join q on q.id = n.id")
def edge_conv(t):
    return out(C.edge_conv(t.b, lambda z: vec.linear(z, EC)))


CG_F, CG_S = [[.02, .01], [.03, -.02], [-.01, .02], [.01, .01], [.01, -.01]], [[-.02, .03], [.01, .01], [.02, -.01], [.02, .02], [.01, .01]]
Z = "i.x0,i.x1,j.x0,j.x1,w"


@query("le ln", "with q as (select e.dst as id, " + ", ".join(
    f"sum(1/(1+exp(-{lin(Z, CG_F, k)})) * ln(1+exp({lin(Z, CG_S, k)}))) s{k}" for k in (0, 1))
       + " from le e join ln j on j.id = e.src join ln i on i.id = e.dst group by 1) select n.id, "
       + rnd("coalesce(s0,0)+x0", "coalesce(s1,0)+x1") + " from ln n left join q on q.id = n.id")
def cg_conv(t):
    return out(C.cg_conv(t.b, CG_F, CG_S, [F.col("w")]))


@query("le ln", """with e as (select dst, greatest(x0,0)+1e-7 m0, greatest(x1,0)+1e-7 m1 from le join ln on id = src),
  t as (select max(0.1*m0) t0, max(0.1*m1) t1 from e),
  q as (select dst as id, sum(m0*exp(0.1*m0-t0))/(sum(exp(0.1*m0-t0))+1e-16) s0, sum(m1*exp(0.1*m1-t1))/(sum(exp(0.1*m1-t1))+1e-16) s1 from e, t group by 1)
  select n.id, """ + rnd("coalesce(s0,0)+x0", "coalesce(s1,0)+x1") + " from ln n left join q on q.id = n.id")
def gen_conv_softmax(t):
    return out(C.gen_conv(t.b, t=0.1))


@query("le ln", """with e as (select dst, least(greatest(x0+1e-7,1e-7),10) m0, least(greatest(x1+1e-7,1e-7),10) m1 from le join ln on id = src),
  q as (select dst as id, avg(m0*m0) s0, avg(m1*m1) s1 from e group by 1)
  select n.id, """ + rnd(*[f"sqrt(least(greatest(coalesce(s{k},0),1e-7),10))+x{k}" for k in (0, 1)]) + " from ln n left join q on q.id = n.id")
def gen_conv_power(t):
    return out(C.gen_conv(t.b, "power", p=2.0))


PNA = """with q as (select dst as id, count(*) n, sum(x0) s, min(x0) lo, max(x0) hi, sum(x0*x0) q from le join ln on id = src group by 1),
  a as (select l.id, coalesce(n,0) n, coalesce(s,0) s, coalesce(lo,0) lo, coalesce(hi,0) hi, coalesce(q,0) q, greatest(coalesce(n,0),1) d from ln l left join q on q.id = l.id),
  g as (select avg(n) lin, avg(ln(n+1)) lg from a),
  v as (select a.*, lin, lg, ln(d+1)/lg as amp, d/lin as linr, sqrt(greatest(q/d-(s/d)*(s/d),0)+1e-5) sd from a, g)"""


@query("le ln", PNA + " select id, " + rnd("s", "s/d", "lo", "hi", "sd", "s*amp", "s/d*amp", "lo*amp", "hi*amp", "sd*amp",
                                          "s*amp*linr", "s/d*amp*linr", "lo*amp*linr", "hi*amp*linr", "sd*amp*linr", digits=5) + " from v")
def pna_conv(t):
    one = t.lines.withColumn("x", F.array(F.col("x")[0]))
    return out(C.pna_conv(Graph(one, t.line_edges, 1), ["sum", "mean", "min", "max", "std"],
                          ["identity", "amplification", "linear"]), 5, 15)


LOOPS = "l as (select src, dst from {e} where src <> dst union all select id, id from {n})"


@query("spu spn", "with " + LOOPS.format(e="spu", n="spn") + """, u as (select id, x0, x1, greatest(sqrt(x0*x0+x1*x1),1e-12) r from spn),
  s as (select l.dst, j.x0, j.x1, exp(2*(i.x0*j.x0+i.x1*j.x1)/(i.r*j.r)) z from l join u j on j.id = l.src join u i on i.id = l.dst)
  select dst as id, """ + rnd("sum(z*x0)/sum(z)", "sum(z*x1)/sum(z)") + " from s group by 1")
def agnn_conv(t):
    return out(C.agnn_conv(t.g, 2.0))


def leaky(e):
    return f"case when {e} > 0 then {e} else 0.2*({e}) end"


GAT = ("with " + LOOPS.format(e="spu", n="spn") + ", v as (select id, " + ", ".join(
    f"{lin('x0,x1', m, c)} as v{h}{c}" for h, m in enumerate([W, V]) for c in (0, 1)) + " from spn), "
    + "s as (select l.dst, j.*, " + ", ".join(
        f"(0.6*j.v{h}0-0.4*j.v{h}1)+(-0.4*i.v{h}0+0.6*i.v{h}1) as a{h}" for h in (0, 1))
    + " from l join v j on j.id = l.src join v i on i.id = l.dst), z as (select *, "
    + ", ".join(f"exp({leaky(f'a{h}')}) as z{h}" for h in (0, 1)) + " from s)")


@query("spu spn", GAT + " select dst as id, " + rnd(*[f"sum(z{h}*v{h}{c})/sum(z{h})" for h in (0, 1) for c in (0, 1)]) + " from z group by 1")
def gat_conv(t):
    return out(C.gat_conv(t.g, [W, V], [ATT, ATT], [ATT[::-1], ATT[::-1]]), dim=4)


@query("le ln", "with v as (select id, x0, x1, " + ", ".join(f"{lin('x0,x1', [[a/10 for a in r] for r in m], c)} as {n}{c}" for n, m in (("q", W), ("k", V)) for c in (0, 1))
       + ", " + ", ".join(f"{lin('x0,x1', U, c)} as v{c}" for c in (0, 1)) + " from ln), s as (select e.dst, j.v0+0.01*w v0, j.v1-0.01*w v1, "
       + "(i.q0*(j.k0+0.01*w)+i.q1*(j.k1-0.01*w))/sqrt(2) u from le e join v j on j.id = e.src join v i on i.id = e.dst), "
       + "r as (select *, exp(u - max(u) over ()) z from s), "
       + "q as (select dst, sum(z*v0)/(sum(z)+1e-16) a, sum(z*v1)/(sum(z)+1e-16) b from r group by 1) select n.id, "
       + rnd(*[f"coalesce({'ab'[k]},0) + {lin('x0,x1', W, k)}" for k in (0, 1)], digits=5) + " from ln n left join q on q.dst = n.id")
def transformer_conv(t):
    small = lambda m: [[a / 10 for a in r] for r in m]
    return out(C.transformer_conv(t.b, small(W), small(V), U, W, [F.col("w") * 0.01, F.col("w") * -0.01]), 5)


@query("le ln", "with " + LOOPS.format(e="le", n="ln") + ", s as (select l.dst, j.x0, j.x1, "
       + ", ".join(f"exp({lin('(j.x0-i.x0)/10,(j.x1-i.x1)/10', W, h, B)}) z{h}" for h in (0, 1))
       + " from l join ln j on j.id = l.src join ln i on i.id = l.dst) select dst as id, "
       + rnd(*[f"avg((z0*{lin('x0,x1', W, c)} + z1*{lin('x0,x1', V, c)})/(z0+z1)) + ({B[c]})" for c in (0, 1)]) + " from s group by 1")
def feast_conv(t):
    return out(C.feast_conv(t.b, [W, V], [[a / 10 for a in r] for r in W], B, B))


ET = "e as (select src, dst, w, (w::bigint % 2)::int as etype from spu)"


def typed(t):
    return Graph(t.sp_nodes, t.spu.withColumn("etype", (F.col("w").cast("bigint") % 2).cast("int")), 2)


RG = "with " + ET + ", m as (select dst, etype, avg(x0) m0, avg(x1) m1 from e join spn on id = src group by 1, 2), s as (select dst, " + ", ".join(
    f"sum(case etype when 0 then {lin('m0,m1', W, c)} else {lin('m0,m1', V, c)} end) s{c}" for c in (0, 1)) + " from m group by 1)"


@query("spu spn", RG + " select n.id, " + rnd(*[f"coalesce(s{c},0) + {lin('x0,x1', U, c)} + ({B[c]})" for c in (0, 1)]) + " from spn n left join s on s.dst = n.id")
def rgcn_conv(t):
    return out(C.rgcn_conv(typed(t), [W, V], U, b=B))


@query("spu spn", RG.replace(lin("m0,m1", W, 0), lin("m0,m1", [[.7, 0], [0, .2]], 0)).replace(lin("m0,m1", W, 1), lin("m0,m1", [[.7, 0], [0, .2]], 1))
       .replace(lin("m0,m1", V, 0), lin("m0,m1", [[-.4, 0], [0, .9]], 0)).replace(lin("m0,m1", V, 1), lin("m0,m1", [[-.4, 0], [0, .9]], 1))
       + " select n.id, " + rnd("coalesce(s0,0)", "coalesce(s1,0)") + " from spn n left join s on s.dst = n.id")
def rgcn_conv_blocks(t):
    return out(C.rgcn_conv(typed(t), C.block_weights([[[[.7]], [[.2]]], [[[-.4]], [[.9]]]])))


@query("spu spn", RG.replace(lin("m0,m1", W, 0), lin("m0,m1", [[0.5 * a - 0.5 * b for a, b in zip(x, y)] for x, y in zip(W, V)], 0))
       .replace(lin("m0,m1", W, 1), lin("m0,m1", [[0.5 * a - 0.5 * b for a, b in zip(x, y)] for x, y in zip(W, V)], 1))
       + " select n.id, " + rnd("coalesce(s0,0)", "coalesce(s1,0)") + " from spn n left join s on s.dst = n.id")
def rgcn_conv_bases(t):
    return out(C.rgcn_conv(typed(t), C.basis_weights([[0.5, -0.5], [0.0, 1.0]], [W, V])))


FILM = [[.1, .2, .3, .1], [.05, -.1, .2, .1]]


def film(v, h, c):
    return f"greatest({lin(v, FILM, 2 + c)}*{h} + {lin(v, FILM, c)}, 0)"


@query("spu spn", "with " + ET + ", m as (select dst, etype, " + ", ".join(
    f"avg(case etype when 0 then {film('i.x0,i.x1', lin('j.x0,j.x1', W, c), c)} else {film('i.x0,i.x1', lin('j.x0,j.x1', V, c), c)} end) s{c}" for c in (0, 1))
       + " from e join spn j on j.id = src join spn i on i.id = dst group by 1, 2), s as (select dst, sum(s0) s0, sum(s1) s1 from m group by 1) select n.id, "
       + rnd(*[f"coalesce(s{c},0) + {film('x0,x1', lin('x0,x1', U, c), c)}" for c in (0, 1)], digits=5) + " from spn n left join s on s.dst = n.id")
def film_conv(t):
    return out(C.film_conv(typed(t), U, FILM, [W, V], [FILM, FILM]), 5)


@query("spu spn", "with " + ET + """, r as (select dst, avg(case when etype = 0 then x0 end) p0, avg(case when etype = 0 then x1 end) p1,
  avg(case when etype = 1 then x0 end) n0, avg(case when etype = 1 then x1 end) n1 from e join spn on id = src group by 1),
  m as (select dst, coalesce(p0,0) p0, coalesce(p1,0) p1, coalesce(n0,0) n0, coalesce(n1,0) n1 from r)
  select n.id, """ + rnd(*[f"{lin('p0,p1', W, c)} + {lin('x0,x1', V, c)}" for c in (0, 1)],
                         *[f"{lin('n0,n1', V, c)} + {lin('x0,x1', U, c)}" for c in (0, 1)]) + " from spn n left join m on m.dst = n.id")
def signed_conv(t):
    g = typed(t)
    return out(C.signed_conv(g, g.edges.filter("etype = 0"), g.edges.filter("etype = 1"), W, V, V, U), dim=4)


@query("spu spn", "with " + ET + """, r as (select dst, avg(case when etype = 0 then x0 end) p0, avg(case when etype = 0 then x1 end) p1,
  avg(case when etype = 1 then x0 end) n0, avg(case when etype = 1 then x1 end) n1 from e join spn on id = src group by 1),
  m as (select dst, coalesce(p0,0) p0, coalesce(p1,0) p1, coalesce(n0,0) n0, coalesce(n1,0) n1 from r)
  select n.id, """ + rnd(*[f"{lin('p0,n1', W, c)} + x0*({V[0][c]})" for c in (0, 1)],
                         *[f"{lin('p1,n0', V, c)} + x1*({U[0][c]})" for c in (0, 1)]) + " from spn n left join m on m.dst = n.id")
def signed_conv_deep(t):
    g = typed(t)
    return out(C.signed_conv(g, g.edges.filter("etype = 0"), g.edges.filter("etype = 1"), W, V[:1], V, U[:1], first=False), dim=4)


@query("le ln", "with q as (select e.dst as id, " + ", ".join(
    f"sum(x0*({W[0][c]}+w*({V[0][c]})) + x1*({W[1][c]}+w*({V[1][c]}))) s{c}" for c in (0, 1))
       + " from le e join ln j on j.id = e.src group by 1) select n.id, " + rnd(*[f"coalesce(s{c},0) + {lin('x0,x1', U, c)}" for c in (0, 1)], digits=4)
       + " from ln n left join q on q.id = n.id")
def nn_conv(t):
    return out(C.nn_conv(t.b, lambda: [[F.lit(W[r][c]) + F.col("w") * V[r][c] for c in (0, 1)] for r in (0, 1)], U), 4)


@query("le ln", "with e as (select src, dst, 1/w as p from le), q as (select e.dst as id, " + ", ".join(
    "avg(" + "+".join(f"exp(-0.5*(p-{mu})*(p-{mu})/(1e-15+{sg}*{sg}))*{lin('x0,x1', m, c)}" for m, mu, sg in ((W, .2, .5), (V, .8, .3))) + f") s{c}" for c in (0, 1))
       + " from e join ln j on j.id = e.src group by 1) select n.id, " + rnd(*[f"coalesce(s{c},0) + {lin('x0,x1', U, c)}" for c in (0, 1)])
       + " from ln n left join q on q.id = n.id")
def gmm_conv(t):
    return out(C.gmm_conv(t.b, [1 / F.col("w")], [W, V], [[.2], [.8]], [[.5], [.3]], U))


@query("le ln", "with e as (select src, dst, 2/w as p from le), q as (select e.dst as id, " + ", ".join(
    "avg((1-abs(p-0))*(p<1)::int*" + lin("x0,x1", W, c) + " + (1-abs(p-1))*" + lin("x0,x1", V, c) + " + (p-1)*(p>1)::int*" + lin("x0,x1", U, c) + f") s{c}" for c in (0, 1))
       + " from e join ln j on j.id = e.src group by 1) select n.id, " + rnd(*[f"coalesce(s{c},0) + {lin('x0,x1', V, c)}" for c in (0, 1)])
       + " from ln n left join q on q.id = n.id")
def spline_conv(t):
    return out(C.spline_conv(t.b, [1 / F.col("w")], [3], [W, V, U], V))


def placed(t):
    """order lines with a position and a unit normal"""
    pos = F.array(F.col("x")[0] / 10, F.col("x")[1], (F.col("id") % 5).cast("double"))
    n = F.array(F.lit(0.6), F.when(F.col("id") % 2 == 0, 0.8).otherwise(0.0), F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.8))
    return Graph(t.lines.withColumn("pos", pos).withColumn("normal", n), t.line_edges, 2)


POS = "p as (select id, x0, x1, x0/10 as a, x1 as b, (id % 5)::double as c, 0.6 as na, case when id % 2 = 0 then 0.8 else 0 end as nb, case when id % 2 = 0 then 0 else 0.8 end as nc from ln)"


@query("le ln", "with " + LOOPS.format(e="le", n="ln") + ", " + POS + " select l.dst as id, " + rnd(
    "max(j.x0)", "max(j.x1)", "max(j.a-i.a)", "max(j.b-i.b)", "max(j.c-i.c)") + " from l join p j on j.id = l.src join p i on i.id = l.dst group by 1")
def point_conv(t):
    return out(C.point_conv(placed(t), 3), dim=5)


def angle(u, v):
    (a, b, c), (d, e, f) = u, v
    return f"atan2(sqrt(({b}*{f}-{c}*{e})*({b}*{f}-{c}*{e})+({c}*{d}-{a}*{f})*({c}*{d}-{a}*{f})+({a}*{e}-{b}*{d})*({a}*{e}-{b}*{d})), {a}*{d}+{b}*{e}+{c}*{f})"


D3 = ("(j.a-i.a)", "(j.b-i.b)", "(j.c-i.c)")
NI, NJ = ("i.na", "i.nb", "i.nc"), ("j.na", "j.nb", "j.nc")
DIST3 = "sqrt(" + "+".join(f"{d}*{d}" for d in D3) + ")"


@query("le ln", "with " + LOOPS.format(e="le", n="ln") + ", " + POS + " select l.dst as id, " + rnd(
    "max(j.x0)", "max(j.x1)", f"max({DIST3})", f"max({angle(NI, D3)})", f"max({angle(NJ, D3)})", f"max({angle(NI, NJ)})")
       + " from l join p j on j.id = l.src join p i on i.id = l.dst group by 1")
def ppf_conv(t):
    return out(C.ppf_conv(placed(t)), dim=6)


@query("spn", f"""with inc as (select distinct l_partkey*2+1 as node, l_orderkey as h, 1.0 + l_orderkey % 3 as hw from lineitem),
  x as (select id, {lin('x0,x1', W, 0)} a, {lin('x0,x1', W, 1)} b from spn),
  e as (select h, avg(a)*max(hw) a, avg(b)*max(hw) b from inc join x on x.id = inc.node group by 1),
  d as (select node, sum(e.a)/sum(hw) a, sum(e.b)/sum(hw) b from inc join e using (h) group by 1)
  select n.id, """ + rnd("coalesce(a,0)", "coalesce(b,0)") + " from spn n left join d on d.node = n.id")
def hypergraph_conv(t):
    inc = t.read("lineitem").select((F.col("l_partkey") * 2 + 1).alias("node"), F.col("l_orderkey").alias("hyperedge"),
                                    (F.col("l_orderkey") % 3 + 1.0).alias("hw")).distinct()
    return out(C.hypergraph_conv(t.sp_nodes, inc, 2, W))


WL = """with c0 as (select id, graph_id, y::bigint as color from ln),
  k1 as (select n.id, n.graph_id, n.color, (select list_sort(list(m.color)) from le e join c0 m on m.id = e.src where e.dst = n.id) as near from c0 n),
  c1 as (select id, graph_id, min(id) over (partition by color, near) as color from k1),
  l2 as (select e.dst, list_sort(list(m.color)) as near from le e join c1 m on m.id = e.src group by 1),
  c2 as (select n.id, n.graph_id, min(n.id) over (partition by n.color, l.near) as color from c1 n left join l2 l on l.dst = n.id)"""


def wl(t):
    n = t.lines.select("graph_id", "id", F.col("y").cast("bigint").alias("color"))
    return C.wl_conv(C.wl_conv(n, t.line_edges), t.line_edges)


@query("le ln", WL + " select id, color from c2")
def wl_conv(t):
    return wl(t).select("id", "color")


@query("le ln", WL + " select graph_id, color, count(*) as n from c2 group by 1, 2")
def wl_histogram(t):
    return C.wl_histogram(wl(t))


GRU_I, GRU_H = [[.1, .2, -.1, .3, .05, .1], [.2, -.1, .1, .1, .15, -.2]], [[-.1, .1, .2, .05, .1, .1], [.1, .1, -.1, .2, -.05, .1]]


def gru(h, m, k):
    i = lambda g: lin(m, GRU_I, 2 * g + k)
    hh = lambda g: lin(h, GRU_H, 2 * g + k)
    sg = lambda e: f"(1/(1+exp(-({e}))))"
    n = f"tanh({i(2)} + {sg(i(0) + '+' + hh(0))}*{hh(2)})"
    return f"((1-{sg(i(1) + '+' + hh(1))})*{n} + {sg(i(1) + '+' + hh(1))}*{h.split(',')[k]})"


@query("gcn spn", f"with m0 as (select id, {lin('x0,x1', W, 0)} x0, {lin('x0,x1', W, 1)} x1 from spn), " + prop("gcn", "m0", "p")
       + f", h1 as (select p.id, {gru('n.x0,n.x1', 'p0,p1', 0)} x0, {gru('n.x0,n.x1', 'p0,p1', 1)} x1 from p join spn n on n.id = p.id) select id, "
       + rnd("x0", "x1") + " from h1")
def gated_graph_conv(t):
    from ..operators.reduce import gcn_norm
    return out(C.gated_graph_conv(t.g.with_edges(gcn_norm(t.spu, t.sp_nodes)), [W], GRU_I, GRU_H))


@query("gcn spn", "with s as (select e.dst, e.w, "
       + f"({lin('i.x1,i.x0', W, 0)}*{lin('j.x0,j.x1', V, 0)} + {lin('i.x1,i.x0', W, 1)}*{lin('j.x0,j.x1', V, 1)})/sqrt(2)/100 s0, "
       + f"({lin('i.x1,i.x0', W, 0)}*{lin('j.x1,j.x0', V, 0)} + {lin('i.x1,i.x0', W, 1)}*{lin('j.x1,j.x0', V, 1)})/sqrt(2)/100 s1, "
       + ", ".join(f"{lin('j.x0,j.x1', U, c)} a{c}, {lin('j.x1,j.x0', U, c)} b{c}" for c in (0, 1))
       + " from gcn e join spn j on j.id = e.src join spn i on i.id = e.dst) select dst as id, "
       + rnd(*[f"sum(w*(exp(s0)*a{c}+exp(s1)*b{c})/(exp(s0)+exp(s1)+1))" for c in (0, 1)]) + " from s group by 1")
def dna_conv(t):
    nodes = t.sp_nodes.withColumn("h1", F.array(F.col("x")[1], F.col("x")[0]))
    scale = lambda m: [[a / 100 for a in r] for r in m]
    return out(C.dna_conv(Graph(nodes, t.spu, 2), ["x", "h1"], W, scale(V), U))
