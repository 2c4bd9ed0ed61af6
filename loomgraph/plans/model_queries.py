"""Label spreading, decoders, triplets and the graph classifier."""
from pyspark.sql import functions as F

from ..core import vec
from ..graph import Graph
from ..operators import models as M
from .catalog import query
from .conv_queries import B, U, V, W, lin, out, rnd
from .reduce_queries import flat, rounded, rounded_sql

STEP = """{t} as (select n.id, {c0} as x0, {c1} as x1, {c2} as x2 from {s} n left join
  (select e.dst as id, sum(e.w*m.x0) s0, sum(e.w*m.x1) s1, sum(e.w*m.x2) s2 from adj e join {f} m on m.id = e.src group by 1) q on q.id = n.id)"""


def spread(src, steps, alpha, lo, hi, tag):
    ctes = []
    for k in range(1, steps + 1):
        f = src if k == 1 else f"{tag}{k-1}"
        cols = {f"c{c}": f"least(greatest({alpha}*coalesce(s{c},0) + {round(1-alpha, 6)}*n.x{c}, {lo}), {hi})" for c in range(3)}
        ctes.append(STEP.format(t=f"{tag}{k}", s=src, f=f, **cols))
    return ", ".join(ctes)


def masked(t):
    return Graph(t.sp_nodes.withColumn("mask", F.col("id") % 3 == 0), t.spu, 2)


Y0 = "y as (select id, " + ", ".join(f"(y = {c} and id % 3 = 0)::int::double as x{c}" for c in range(3)) + " from spn)"


@query("adj spn", "with " + Y0 + ", " + spread("y", 3, 0.7, 0, 1, "k") + " select id, " + rnd("x0", "x1", "x2") + " from k3")
def label_propagation(t):
    return out(M.label_propagation(masked(t), 3, 3, 0.7), dim=3)


SOFT = "soft as (select id, 0.5 as x0, 0.3 as x1, 0.2 as x2, y, id % 3 = 0 as mask from spn)"
CS = ("with " + SOFT + ", err as (select id, " + ", ".join(f"case when mask then (y = {c})::int - x{c} else 0 end as x{c}" for c in range(3)) + " from soft), "
      + spread("err", 2, 0.8, -1, 1, "e") + ", sg as (select avg(abs(x0)+abs(x1)+abs(x2)) s from err where id % 3 = 0), "
      + "cr as (select s.id, s.y, s.mask, " + ", ".join(
          f"s.x{c} + e.x{c} * (case when abs(e.x0)+abs(e.x1)+abs(e.x2) = 0 or sg.s/(abs(e.x0)+abs(e.x1)+abs(e.x2)) > 1000 then 1 else sg.s/(abs(e.x0)+abs(e.x1)+abs(e.x2)) end) as x{c}" for c in range(3))
      + " from soft s join e2 e on e.id = s.id, sg)")


def cs(t):
    soft = t.sp_nodes.select("id", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("x"))
    return M.correct_and_smooth(masked(t), soft, 3, 2, 0.8, 2, 0.6)


@query("adj spn", CS + " select id, " + rnd("x0", "x1", "x2") + " from cr")
def correct_step(t):
    return out(cs(t)[0], dim=3)


@query("adj spn", CS + ", st as (select id, " + ", ".join(f"case when mask then (y = {c})::int::double else x{c} end as x{c}" for c in range(3)) + " from cr), "
       + spread("st", 2, 0.6, 0, 1, "m") + " select id, " + rnd("x0", "x1", "x2") + " from m2")
def smooth_step(t):
    return out(cs(t)[1], dim=3)


@query("sp spn", f"select src, dst, {rounded_sql('1/(1+exp(-(a.x0*b.x0/10 + a.x1*b.x1/1000)))')} as score from sp join spn a on a.id = src join spn b on b.id = dst")
def inner_product_decoder(t):
    z = t.sp_nodes.withColumn("x", F.array(F.col("x")[0] / 10 ** 0.5, F.col("x")[1] / 1000 ** 0.5))
    return M.inner_product_decoder(z, t.sp, 2).select("src", "dst", rounded(F.col("score")).alias("score"))


DEC = "d as (select w > 30 as pos, a.x1*b.x1/1000 as s from sp join spn a on a.id = src join spn b on b.id = dst)"


def z1(t):
    return t.sp_nodes.withColumn("x", F.array(F.col("x")[1] / 1000 ** 0.5))


@query("sp spn", "with " + DEC + ", g as (select round(s, 9) s, count(*) filter (where pos) p, count(*) filter (where not pos) q from d group by 1), r as (select *, sum(p) over (order by s desc) tp from g) select round(sum((2*tp-p)*q/2)/(sum(p)*sum(q)), 6) as auc from r")
def decoder_auc(t):
    auc, _ = M.reconstruction_metrics(z1(t), t.sp.filter("w > 30"), t.sp.filter("w <= 30"), 1)
    return auc.select(F.round("auc", 6).alias("auc"))


@query("sp spn", "with " + DEC + " select round(-avg(case when pos then ln(1/(1+exp(-s))+1e-15) end) - avg(case when not pos then ln(1-1/(1+exp(-s))+1e-15) end), 6) as loss from d")
def decoder_loss(t):
    return M.reconstruction_loss(z1(t), t.sp.filter("w > 30"), t.sp.filter("w <= 30"), 1).select(F.round("loss", 6).alias("loss"))


@query("ln", "select round(-0.5*avg(2 + 2*0.01*x0 + 2*0.02*x1 - x0*x0/100 - x1*x1/100 - exp(0.02*x0) - exp(0.04*x1)), 6) as kl from ln")
def kl_loss(t):
    x = vec.parts("x", 2)
    return t.lines.agg(F.round(M.kl_loss([c / 10 for c in x], [x[0] * 0.01, x[1] * 0.02]), 6).alias("kl"))


@query("le", "select a.src as k, a.dst as j, b.dst as i from le a join le b on a.dst = b.src where a.src <> b.dst")
def path_triplets(t):
    return M.path_triplets(t.line_edges)


@query("le ln", "with a as (select src, dst, w from le union all select id, id, 1.0 from ln) select x.src, y.dst, sum(x.w*y.w) as w from a x join a y on x.dst = y.src where x.src <> y.dst group by 1, 2")
def augment_adjacency(t):
    return M.augment_adjacency(t.line_edges, t.lines)


@query("ln", "select id, " + rnd("greatest(x0, x1)", "greatest(x1, x0/2)") + " from ln")
def jumping_knowledge_max(t):
    n = t.lines.withColumn("h1", F.array(F.col("x")[1], F.col("x")[0] / 2))
    return out(M.jumping_knowledge(n, ["x", "h1"], 2, "max"))


@query("le ln", "with p as (select dst, sum(w*(0.5*cos(pi()*w/60)+0.5)*x0*exp(-0.5/(20.0*20.0)*(w-20)*(w-20))) s from le join ln on id = src group by 1) select ln.id, " + rnd("coalesce(s,0)", digits=4) + " from ln left join p on p.dst = ln.id")
def schnet_filter(t):
    n = t.lines.withColumn("x", F.array(F.col("x")[0]))
    e = t.line_edges
    got = M.schnet_interaction(Graph(n, e, 1), F.col("w"), 60.0, [[0.0], [1.0], [0.0], [0.0]], 4)
    # the filter weighs basis function two; the edge weight scales the message
    from ..operators.propagate import propagate
    from ..functions.scalar import gaussian_smearing
    import math
    msg = lambda j, i: [F.col("w") * (0.5 * F.cos(F.col("w") * math.pi / 60) + 0.5) * j.vec()[0] * gaussian_smearing(F.col("w"), 0.0, 60.0, 4)[1]]
    return out(propagate(Graph(n, e, 1), msg).select("id", "out").join(got.select("id"), "id"), 4, 1)


CONV = lambda e, n, w, v, b: [f"greatest({lin('p0,p1', w, k, b)} + {lin('x0,x1', v, k)}, 0)" for k in (0, 1)]
HEAD1, HB1 = [[.2, -.1], [.1, .3], [-.2, .2], [.15, -.25], [.05, .1]], [0.1, 0.0]
HEAD2, HB2 = [[.3, -.2, .1, .2], [-.1, .2, .3, -.3]], [0.0, 0.1, -0.1, 0.05]


@query("le ln", "with p as (select n.id, n.graph_id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from ln n left join (select e.dst as id, sum(w*m.x0) s0, sum(w*m.x1) s1 from le e join ln m on m.id = e.src group by 1) q on q.id = n.id), "
       + "h as (select id, graph_id, " + ", ".join(f"{e} as x{k}" for k, e in enumerate(CONV("le", "ln", W, V, B)))
       + " from p), p2 as (select n.id, n.graph_id, n.x0, n.x1, coalesce(s0,0) p0, coalesce(s1,0) p1 from h n left join (select e.dst as id, sum(w*m.x0) s0, sum(w*m.x1) s1 from le e join h m on m.id = e.src group by 1) q on q.id = n.id), "
       + "k as (select id, graph_id, x0, x1, " + ", ".join(f"{e} as y{k}" for k, e in enumerate(CONV("le", "ln", U, W, B)))
       + " from p2), g as (select graph_id, max(x0) a, max(x1) b, max(y0) c, max(y1) d, count(*)::double n from k group by 1), "
       + "z as (select graph_id, " + ", ".join(f"greatest({lin('a,b,c,d,n', HEAD1, k, HB1)}, 0) z{k}" for k in (0, 1)) + " from g), "
       + "s as (select graph_id, [" + ", ".join(lin("z0,z1", HEAD2, k, HB2) for k in range(4)) + "] s from z) select graph_id, (list_position(s, list_max(s)) - 1)::int as label from s")
def classify_graphs(t):
    info = t.lines.groupBy("graph_id").agg(F.count("*").alias("n"))
    got = M.graph_classifier(t.lines, t.line_edges, info, 2, ["n"], (W, V, B), (U, W, B), [(HEAD1, HB1), (HEAD2, HB2)])
    return got.select("graph_id", "label")
