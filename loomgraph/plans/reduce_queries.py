"""Degrees, normalisations, readouts, norms and metrics."""
from pyspark.sql import functions as F

from ..core import vec
from ..operators import metrics as M
from ..operators import reduce as R
from ..operators.edges import coalesce_edges
from ..operators.propagate import group_softmax
from .catalog import query


def rounded(c, digits=6):
    """Round off decimal ties: prices and quantities often sum to exact halves of the last
    digit, where the order of summation would decide the way they round."""
    return F.round(c + 0.0337 * 10.0 ** -digits, digits)


def rounded_sql(e, digits=6):
    return f"round({e} + {0.0337 * 10.0 ** -digits!r}, {digits})"


def flat(df, *keys, col="x", dim=2, digits=6, prefix="x"):
    """Array column as rounded scalar columns."""
    return df.select(*keys, *[rounded(F.col(col)[k], digits).alias(f"{prefix}{k}") for k in range(dim)])


@query("le ln", "select id, coalesce(n, 0)::double as deg from ln left join (select src, count(*) n from le group by 1) on src = id")
def degree_out(t):
    return R.degree(t.line_edges, t.lines)


@query("ev", "select dst as id, count(*)::double as deg from ev group by 1")
def degree_in(t):
    return R.degree(t.ev, t.ev.select(F.col("dst").alias("id")).distinct(), "dst")


@query("sp spn", "select id, coalesce(s, 0) as deg from spn left join (select dst, sum(w) s from sp group by 1) on dst = id")
def degree_weighted(t):
    return R.degree(t.sp, t.sp_nodes, "dst", "w")


@query("le", """with m as (select max(w) t from le), e as (select src, dst, exp(w - t) s from le, m)
  select src, dst, round(s / (sum(s) over (partition by dst) + 1e-16), 6) as p from e""")
def softmax_by_target(t):
    return group_softmax(t.line_edges.select("src", "dst", "w"), ["w"], "dst").select(
        "src", "dst", F.round("w", 6).alias("p"))


@query("gcn", "select src, dst, round(w, 8) as w from gcn")
def gcn_norm(t):
    return R.gcn_norm(t.spu, t.sp_nodes).select("src", "dst", F.round("w", 8).alias("w"))


@query("spu spn", """with l as (select src, dst, w from spu union all select id, id, 2.0 from spn),
  d as (select dst, sum(w) d from l group by 1) select l.src, l.dst, round(w/sqrt(a.d*b.d), 8) as w
  from l join d a on a.dst = l.src join d b on b.dst = l.dst""")
def gcn_norm_improved(t):
    return R.gcn_norm(t.spu, t.sp_nodes, improved=True).select("src", "dst", F.round("w", 8).alias("w"))


LAP = "with d as (select id, coalesce(s, 0) d from spn left join (select src, sum(w) s from spu group by 1) on src = id)"


@query("spu spn", LAP + " select src, dst, -w as w from spu union all select id, id, d from d")
def laplacian(t):
    return R.get_laplacian(t.spu, t.sp_nodes)


@query("spu spn", LAP + """ select src, dst, round(-w/sqrt(a.d*b.d), 8) as w from spu join d a on a.id = src
  join d b on b.id = dst union all select id, id, 1.0 from d""")
def laplacian_sym(t):
    return R.get_laplacian(t.spu, t.sp_nodes, "sym").select("src", "dst", F.round("w", 8).alias("w"))


@query("spu spn", LAP + """ select src, dst, round(-w/a.d, 8) as w from spu join d a on a.id = src
  union all select id, id, 1.0 from d""")
def laplacian_rw(t):
    return R.get_laplacian(t.spu, t.sp_nodes, "rw").select("src", "dst", F.round("w", 8).alias("w"))


@query("spu", """with d as (select dst, count(*) c from spu group by 1)
  select e.src, e.dst, round(w*(1.0/a.c + 1.0/b.c), 6) as w from spu e join d a on a.dst = e.src join d b on b.dst = e.dst""")
def normalized_cut(t):
    return R.normalized_cut(t.spu, t.sp_nodes).select("src", "dst", F.round("w", 6).alias("w"))


@query("sp spn", "select round(avg((a.y = b.y)::int), 8) as homophily from sp join spn a on a.id = src join spn b on b.id = dst")
def homophily(t):
    return R.homophily_ratio(t.sp, t.sp_nodes).select(F.round("homophily", 8).alias("homophily"))


def pool_sql(agg):
    return f"select graph_id, {rounded_sql(f'{agg}(x0)')} as x0, {rounded_sql(f'{agg}(x1)')} as x1 from ln group by 1"


@query("ln", pool_sql("sum"))
def global_add_pool(t):
    return flat(R.global_pool(t.lines, 2, "add"), "graph_id")


@query("ln", pool_sql("avg"))
def global_mean_pool(t):
    return flat(R.global_pool(t.lines, 2, "mean"), "graph_id")


@query("ln", pool_sql("max"))
def global_max_pool(t):
    return flat(R.global_pool(t.lines, 2, "max"), "graph_id")


@query("ln", """with r as (select graph_id, x0, x1, row_number() over (partition by graph_id order by x1 desc, id) k from ln)
  select graph_id, coalesce(max(case when k=1 then x0 end),0) as x0, round(coalesce(max(case when k=1 then x1 end),0) + 3.37e-08, 6) as x1,
  coalesce(max(case when k=2 then x0 end),0) as x2, round(coalesce(max(case when k=2 then x1 end),0) + 3.37e-08, 6) as x3,
  coalesce(max(case when k=3 then x0 end),0) as x4, round(coalesce(max(case when k=3 then x1 end),0) + 3.37e-08, 6) as x5 from r group by 1""")
def global_sort_pool(t):
    return flat(R.global_sort_pool(t.lines, 2, 3), "graph_id", dim=6)


@query("ln", """with g as (select *, 0.05*x0 - 0.1*x1 as s from ln), e as (select *, exp(s - max(s) over ()) z from g),
  a as (select *, z/(sum(z) over (partition by graph_id) + 1e-16) p from e)
  select graph_id, round(sum(p*x0) + 3.37e-07, 5) as x0, round(sum(p*x1) + 3.37e-07, 5) as x1 from a group by 1""")
def global_attention(t):
    return flat(R.global_attention(t.lines, 2, [0.05, -0.1]), "graph_id", digits=5)


# weights by a rule, so that the SQL can spell them out
S2S_IN = [[((3 * r + 5 * c) % 7 - 3) * 0.05 for c in range(8)] for r in range(4)]
S2S_STATE = [[((2 * r + 3 * c) % 5 - 2) * 0.1 for c in range(8)] for r in range(2)]
S2S_BIAS = [(c % 3 - 1) * 0.2 for c in range(8)]


def set2set_sql(steps):
    ctes = ["s0 as (select distinct graph_id, 0.0::double q0, 0.0::double q1, 0.0::double q2, 0.0::double q3, 0.0::double h0, 0.0::double h1, 0.0::double c0, 0.0::double c1 from ln)"]
    for k in range(1, steps + 1):
        gate = lambda c: " + ".join([f"{S2S_BIAS[c]!r}::double"] + [f"q{r} * {S2S_IN[r][c]!r}::double" for r in range(4)] + [f"h{r} * {S2S_STATE[r][c]!r}::double" for r in range(2)])
        sig = lambda x: f"(1 / (1 + exp(-({x}))))"
        ctes += [f"g{k} as (select graph_id, c0, c1, {', '.join(f'{gate(c)} as z{c}' for c in range(8))} from s{k - 1})",
                 f"n{k} as (select graph_id, z6, z7, {', '.join(f'{sig(f"z{2 + j}")} * c{j} + {sig(f"z{j}")} * tanh(z{4 + j}) as c{j}' for j in range(2))} from g{k})",
                 f"m{k} as (select graph_id, c0, c1, {sig('z6')} * tanh(c0) as h0, {sig('z7')} * tanh(c1) as h1 from n{k})",
                 f"e{k} as (select ln.graph_id, x0, x1, x0 * h0 + x1 * h1 as s from ln join m{k} using (graph_id))",
                 f"p{k} as (select *, exp(s - max(s) over ()) as z from e{k})",
                 f"a{k} as (select *, z / (sum(z) over (partition by graph_id) + 1e-16) as p from p{k})",
                 f"r{k} as (select graph_id, sum(p * x0) as q2, sum(p * x1) as q3 from a{k} group by 1)",
                 f"s{k} as (select graph_id, h0 as q0, h1 as q1, q2, q3, h0, h1, c0, c1 from m{k} join r{k} using (graph_id))"]
    return "with " + ", ".join(ctes) + f" select graph_id, {', '.join(f'round(q{j} + 3.37e-07, 5) as x{j}' for j in range(4))} from s{steps}"


@query("ln", set2set_sql(3))
def set2set(t):
    return flat(R.set2set(t.lines, 2, S2S_IN, S2S_STATE, S2S_BIAS, 3), "graph_id", dim=4, digits=5)


@query("spn", """with m as (select avg(x0) a, avg(x1) b, var_pop(x0) va, var_pop(x1) vb from spn)
  select id, round((x0-a)/sqrt(va+1e-5) + 3.37e-08, 6) as x0, round((x1-b)/sqrt(vb+1e-5) + 3.37e-08, 6) as x1 from spn, m""")
def batch_norm(t):
    return flat(R.batch_norm(t.sp_nodes, 2), "id")


@query("ln", """select id, round((x0 - avg(x0) over w)/(sqrt(var_pop(x0) over w)+1e-5) + 3.3700000000000003e-06, 4) as x0 from ln
  window w as (partition by graph_id)""")
def instance_norm(t):
    return flat(R.instance_norm(t.lines, 2), "id", dim=1, digits=4)


@query("ln", """with m as (select graph_id, avg(v) mu, var_pop(v) s from (select graph_id, x0 v from ln union all
  select graph_id, x1 from ln) group by 1)
  select id, round((x0-mu)/(sqrt(s)+1e-5) + 3.37e-07, 5) as x0, round((x1-mu)/(sqrt(s)+1e-5) + 3.37e-07, 5) as x1 from ln join m using (graph_id)""")
def layer_norm(t):
    return flat(R.layer_norm(t.lines, 2), "id", digits=5)


@query("ln", """select id, round(x0/sqrt(count(*) over (partition by graph_id)) + 3.37e-08, 6) as x0,
  round(x1/sqrt(count(*) over (partition by graph_id)) + 3.37e-08, 6) as x1 from ln""")
def graph_size_norm(t):
    return flat(R.graph_size_norm(t.lines, 2), "id")


@query("ln", """with c as (select graph_id, id, x0-avg(x0) over w a, x1-avg(x1) over w b from ln window w as (partition by graph_id)),
  p as (select *, avg(a*a+b*b) over (partition by graph_id) q from c)
  select id, round(a/sqrt(1e-5+q) + 3.37e-07, 5) as x0, round(b/sqrt(1e-5+q) + 3.37e-07, 5) as x1 from p""")
def pair_norm(t):
    return flat(R.pair_norm(t.lines, 2), "id", digits=5)


@query("ln", """with c as (select graph_id, id, x0-avg(x0) over w a, x1-avg(x1) over w b from ln window w as (partition by graph_id))
  select id, round(a/(1e-5+sqrt(a*a+b*b)) + 3.37e-07, 5) as x0, round(b/(1e-5+sqrt(a*a+b*b)) + 3.37e-07, 5) as x1 from c""")
def pair_norm_individual(t):
    return flat(R.pair_norm(t.lines, 2, individually=True), "id", digits=5)


@query("ln", """select id, round(0.5*sqrt(x0*x0+x1*x1)*(x1+1)/sqrt((x1+1)*(x1+1)+x0*x0) + 3.37e-08, 6) as x0,
  round(0.5*sqrt(x0*x0+x1*x1)*x0/sqrt((x1+1)*(x1+1)+x0*x0) + 3.37e-08, 6) as x1 from ln""")
def message_norm(t):
    x = vec.parts("x", 2)
    return flat(t.lines.select("id", vec.pack(R.message_norm(x, [x[1] + 1, x[0]], 0.5)).alias("x")), "id")


# metrics: predict a document's quality from its length, a part's size class from its price -----

def judged(t):
    return t.read("documents").join(t.read("labels"), "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") > 1500).cast("int").alias("pred"),
        F.col("quality").alias("target"), "toxic", (F.col("n_chars") % 50).cast("double").alias("score"))


JUDGED = """with d as (select l.doc_id as id, (n_chars > 1500)::int as pred, quality as target, toxic,
  (n_chars % 50)::double as score from documents join labels l using (doc_id))"""
CLASSES = JUDGED + """, k as (select unnest(range(0, 2))::int as class), c as (select class,
  count(*) filter (where pred = class and target = class) as tp, count(*) filter (where pred = class and target <> class) as fp,
  count(*) filter (where pred <> class and target = class) as fn, count(*) filter (where pred <> class and target <> class) as tn
  from d, k group by 1)"""


@query("", JUDGED + " select round(avg((pred = target)::int), 8) as accuracy from d")
def accuracy(t):
    return M.accuracy(judged(t)).select(F.round("accuracy", 8).alias("accuracy"))


@query("", CLASSES + " select * from c")
def confusion_per_class(t):
    return M.confusion(judged(t), 2)


@query("", CLASSES + """, p as (select class, case when tp+fp = 0 then 0 else tp/(tp+fp) end as precision,
  case when tp+fn = 0 then 0 else tp/(tp+fn) end as recall from c)
  select class, round(precision, 8) as precision, round(recall, 8) as recall,
  round(case when precision+recall = 0 then 0 else 2*precision*recall/(precision+recall) end, 8) as f1 from p""")
def precision_recall_f1(t):
    return M.precision_recall_f1(judged(t), 2).select("class", *[
        F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("", JUDGED + """, k as (select unnest(range(0, 2))::int as class) select toxic, class,
  count(*) filter (where pred = class and target = class) as i, count(*) filter (where pred = class or target = class) as u
  from d, k group by 1, 2""")
def intersection_and_union(t):
    return M.intersection_and_union(judged(t), 2, by="toxic")


@query("", JUDGED + """, k as (select unnest(range(0, 2))::int as class), q as (select toxic, class,
  count(*) filter (where pred = class and target = class) as i, count(*) filter (where pred = class or target = class) as u
  from d, k group by 1, 2) select toxic, round(avg(case when u = 0 then 1 else i/u end), 8) as miou from q group by 1""")
def mean_iou(t):
    return M.mean_iou(judged(t), 2, by="toxic").select("toxic", F.round("miou", 8).alias("miou"))


RANKED = JUDGED + """, r as (select score, target, sum((target = 1)::int) over w as tp, sum((target <> 1)::int) over w as fp
  from d window w as (order by score desc, id rows unbounded preceding)),
  n as (select count(*) filter (where target = 1) p, count(*) filter (where target <> 1) q from d)"""


@query("", RANKED + " select round(max((tp - fp + q) * 100.0 / (p + q)), 6) as best_accuracy from r, n")
def best_accuracy(t):
    return M.best_accuracy(judged(t), label="target").select(F.round("best_accuracy", 6).alias("best_accuracy"))


@query("", JUDGED + """ select round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end), 8) as auc
  from d a, d b where a.target = 1 and b.target <> 1""")
def roc_auc(t):
    return M.roc_auc(judged(t), label="target").select(F.round("auc", 8).alias("auc"))


@query("", RANKED + """, u as (select * from r where fp - (target <> 1)::int < 40),
  s as (select score, max(tp) tp, max(fp) fp, sum((target = 1)::int) p1, sum((target <> 1)::int) q1 from u group by 1)
  select round(sum((2*tp - p1) * q1 // 2) / (max(p) * max(fp)), 8) as roc_n from s, n""")
def roc_n(t):
    return M.roc_n(judged(t), 40, label="target").select(F.round("roc_n", 8).alias("roc_n"))


@query("", RANKED + " select round(min(fp / q), 8) as median_rfp from r, n where target = 1 and tp = (p + 1) // 2")
def median_rfp(t):
    return M.median_rfp(judged(t), label="target").select(F.round("median_rfp", 8).alias("median_rfp"))


@query("", "select round(avg(l_quantity), 8) as mean, round(stddev_pop(l_quantity), 8) as std from lineitem")
def mean_and_std(t):
    return M.mean_and_std(t.read("lineitem"), "l_quantity").select(
        F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))
