"""Term-matrix scaling, filters, similarity, itemsets."""
from pyspark.sql import functions as F

from ..operators import textmatrix as X
from .catalog import query
from .reduce_queries import rounded, rounded_sql


def r6(df, *keys):
    return df.select(*(keys or ("i", "j")), rounded(F.col("v")).alias("v"))


@query("tm", f"select i, j, {rounded_sql('v/sqrt(sum(v*v) over (partition by i))')} as v from tm")
def csr_l2_normalize(t):
    return r6(X.normalize(t.tm))


@query("tm", f"select i, j, {rounded_sql('v/sum(v) over (partition by j)')} as v from tm")
def csr_l1_normalize_columns(t):
    return r6(X.normalize(t.tm, "j", 1))


@query("tm", f"select i, j, {rounded_sql('0.5+0.5*v/max(v) over (partition by i)')} as v from tm")
def csr_scale_maxtf(t):
    return r6(X.scale(t.tm, "MAXTF"))


@query("tm", f"select i, j, {rounded_sql('0.1+0.9*v/max(v) over (partition by i)')} as v from tm")
def csr_scale_maxtf2(t):
    return r6(X.scale(t.tm, "MAXTF2"))


@query("tm", f"select i, j, {rounded_sql('0.1+sqrt(v)')} as v from tm")
def csr_scale_sqrt(t):
    return r6(X.scale(t.tm, "SQRT"))


@query("tm", f"select i, j, {rounded_sql('0.1+pow(v,0.65)')} as v from tm")
def csr_scale_pow65(t):
    return r6(X.scale(t.tm, "POW65"))


@query("tm", f"select i, j, {rounded_sql('1+log2(v)')} as v from tm")
def csr_scale_log(t):
    return r6(X.scale(t.tm, "LOG"))


@query("tm", f"select i, j, {rounded_sql('v*ln((select count(distinct i) from tm)/count(*) over (partition by j))')} as v from tm")
def csr_scale_idf(t):
    return r6(X.scale(t.tm, "IDF"))


@query("tm", """with d as (select j, count(*) df from tm group by 1), b as (select greatest(10, floor(sum(df)*0.5/count(*))) b, (select count(distinct i) from tm) n from d)
  select i, tm.j, """ + rounded_sql("v*ln((n+2*b)/(b+df))") + " as v from tm join d on d.j = tm.j, b")
def csr_scale_idf2(t):
    return r6(X.scale(t.tm, "IDF2"))


@query("tm", "select i, j, v from tm where j in (select j from tm group by 1 having count(*) between 5 and 200)")
def csr_prune_columns(t):
    return X.prune(t.tm, "j", 5, 200)


@query("tm", "select i, j, v from tm where i in (select i from tm group by 1 having count(*) between 20 and 150)")
def csr_prune_rows(t):
    return X.prune(t.tm, "i", 20, 150)


@query("tm", """with r as (select *, sum(v) over (partition by i order by v desc, j rows unbounded preceding) run, sum(v) over (partition by i) tot from tm)
  select i, j, v from r where run - v <= 0.25*tot""")
def csr_low_filter(t):
    return X.low_filter(t.tm, "i", 1, 0.25)


@query("m", """with r as (select *, sum(v*v) over (partition by j order by v desc, i rows unbounded preceding) run, sum(v*v) over (partition by j) tot from m)
  select i, j, v from r where run - v*v <= 0.5*tot""")
def csr_low_filter_columns(t):
    return X.low_filter(t.m, "j", 2, 0.5)


@query("tm", "select i, j, v from (select *, row_number() over (partition by i order by v desc, j) r from tm) where r <= 3 or v >= 6")
def csr_top_k_plus(t):
    return X.top_k_plus(t.tm, "i", 3, 6.0)


@query("tm", "select i, j, v from (select *, count(*) over (partition by i) n from tm) where v > 120.0/n")
def csr_z_score_filter(t):
    return X.z_score_filter(t.tm, 120.0)


@query("tm", "with c as (select j, row_number() over (order by count(*) desc, j) - 1 as n from tm group by 1) select i, c.n as j, v from tm join c using (j)")
def csr_compact_columns(t):
    return X.compact_columns(t.tm)


@query("m", "select i, j, v from m where i in (select s_suppkey from supplier where s_nationkey < 5)")
def csr_extract_rows(t):
    return X.extract_rows(t.m, t.read("supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("id")))


@query("m", "select i - 10 as i, j, v from m where i between 10 and 29")
def csr_row_slice(t):
    return X.row_slice(t.m, 10, 20)


@query("m", "select i, j, v from m join supplier on s_suppkey = i where s_nationkey % 4 = 2")
def csr_partition_rows(t):
    part = t.read("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("part"))
    return X.partition_rows(t.m, part, 2)


@query("m", "select i, j, v, (i + j) % 3 as color from m")
def csr_split(t):
    return X.split_by_color(t.m, (F.col("i") + F.col("j")) % 3)


QM = "q as (select item_id as q, j, count(*)::double as v from (select item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as j from benchmark) where j <> '' group by 1, 2)"
UNIT = "u as (select i, j, v/sqrt(sum(v*v) over (partition by i)) v from tm), qu as (select q, j, v/sqrt(sum(v*v) over (partition by q)) v from q)"


def benchmark(t):
    """benchmark items as query rows"""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("j")
    return t.read("benchmark").select(F.col("item_id").alias("q"), words).filter("j <> ''").groupBy("q", "j").agg(F.count("*").cast("double").alias("v"))


def top_sql(sim, src="tm", qs="q", mins=0.0):
    return f"""d as ({sim}), r as (select q, i, sim, row_number() over (partition by q order by round(sim, 9) desc, i) - 1 as rank from d where sim >= {mins})
  select q, i, rank, round(sim, 6) as sim from r where rank < 5"""


def ranked(t, kind, mins=0.0):
    a, q = t.tm, benchmark(t)
    if kind == "COS":
        a = X.normalize(a)
        q = X.normalize(q.withColumnRenamed("q", "i")).withColumnRenamed("i", "q")
    return X.similar_rows(a, q, 5, kind, mins).select("q", "i", "rank", F.round("sim", 6).alias("sim"))


@query("tm", "with " + QM + ", " + UNIT + ", " + top_sql("select q, i, sum(u.v*qu.v) sim from u join qu using (j) group by 1, 2", mins=0.1).replace("select q, i, rank, round(sim, 6) as sim", "select q, rank, round(sim, 6) as sim"))
def csr_similar_rows_cosine(t):
    # near copies tie up to rounding, so the rank and value are compared, not the twin's id
    return ranked(t, "COS", 0.1).drop("i")


@query("tm", "with " + QM + ", qn as (select q, sum(v*v) n from q group by 1), rn as (select i, sum(v*v) n from tm group by 1), "
       + top_sql("select q, i, s/(rn.n+qn.n-s) sim from (select q, i, sum(tm.v*q.v) s from tm join q using (j) group by 1, 2) join qn using (q) join rn using (i)"))
def csr_similar_rows_jaccard(t):
    return ranked(t, "JAC")


@query("tm", "with " + QM + ", qn as (select q, sum(v) n from q group by 1), rn as (select i, sum(v) n from tm group by 1), "
       + top_sql("select q, i, s/(rn.n+qn.n-s) sim from (select q, i, sum(least(tm.v,q.v)) s from tm join q using (j) group by 1, 2) join qn using (q) join rn using (i)"))
def csr_similar_rows_min(t):
    return ranked(t, "MIN")


@query("tm", "with " + QM + ", qn as (select q, sum(v) n from q group by 1), "
       + top_sql("select q, i, s/qn.n sim from (select q, i, sum(least(tm.v,q.v)) s from tm join q using (j) group by 1, 2) join qn using (q)"))
def csr_similar_rows_amin(t):
    return ranked(t, "AMIN")


PAIRS = """p as (select doc_id as i1, doc_id + 1 as i2 from documents where doc_id + 1 in (select doc_id from documents)),
  s as (select i1, i2, sum(a.v*b.v) s, sum(least(a.v,b.v)) m from p join tm a on a.i = i1 join tm b on b.i = i2 and b.j = a.j group by 1, 2),
  n as (select i, sum(v*v) n2, sum(v) n1 from tm group by 1),
  z as (select i1, i2, coalesce(s,0) s, coalesce(m,0) m, coalesce(a.n2,0) a2, coalesce(b.n2,0) b2, coalesce(a.n1,0) a1, coalesce(b.n1,0) b1
  from p left join s using (i1, i2) left join n a on a.i = i1 left join n b on b.i = i2)"""


def neighbours(t):
    d = t.read("documents").select(F.col("doc_id").alias("i1"))
    return d.withColumn("i2", F.col("i1") + 1).join(d.select(F.col("i1").alias("i2")), "i2", "left_semi").select("i1", "i2")


def sims(t, kind):
    return X.pair_similarity(t.tm, neighbours(t), kind).select("i1", "i2", rounded(F.col("sim")).alias("sim"))


@query("tm", "with " + PAIRS + " select i1, i2, " + rounded_sql("case when a2*b2 > 0 then s/sqrt(a2*b2) else 0 end") + " as sim from z")
def csr_similarity_cosine(t):
    return sims(t, "COS")


@query("tm", "with " + PAIRS + " select i1, i2, " + rounded_sql("case when a2+b2-s > 0 then s/(a2+b2-s) else 0 end") + " as sim from z")
def csr_similarity_jaccard(t):
    return sims(t, "JAC")


@query("tm", "with " + PAIRS + " select i1, i2, " + rounded_sql("case when a1+b1-m > 0 then m/(a1+b1-m) else 0 end") + " as sim from z")
def csr_similarity_min(t):
    return sims(t, "MIN")


@query("tm", "with " + PAIRS + " select i1, i2, " + rounded_sql("case when a1 > 0 then m/a1 else 0 end") + " as sim from z")
def csr_similarity_amin(t):
    return sims(t, "AMIN")


@query("", """with b as (select distinct l_orderkey as tid, l_partkey % 200 as item from lineitem), s as (select item from b group by 1 having count(*) >= 15),
  f as (select * from b where item in (select item from s)), p as (select a.item x, b.item y, count(*) c from f a join f b on a.tid = b.tid and a.item < b.item group by 1, 2 having count(*) >= 15),
  h as (select a.item x, b.item y, c.item z, count(*) n from f a join f b on a.tid = b.tid and a.item < b.item join f c on c.tid = a.tid and b.item < c.item group by 1, 2, 3 having count(*) >= 15)
  select item::varchar as items, count(*) as freq from f group by 1 union all select x || ',' || y, c from p union all select x || ',' || y || ',' || z, n from h""")
def frequent_itemsets(t):
    b = t.read("lineitem").select(F.col("l_orderkey").alias("tid"), (F.col("l_partkey") % 200).alias("item"))
    return X.frequent_itemsets(b, 15).select(F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "freq")


def pr_sql(steps):
    ctes = ["n as (select distinct l_suppkey as id from lineitem)", "r as (select id, 1.0/(select count(*) from n) as r from n)",
            "a as (select l_suppkey as i, l_partkey % (select max(l_suppkey)+1 from lineitem) as j, sum(l_quantity) v from lineitem where l_suppkey % 9 <> 0 group by 1, 2)",
            "o as (select i, sum(v) s from a group by 1)", "k0 as (select id, r as pr from r)"]
    for k in range(1, steps + 1):
        ctes.append(f"""k{k} as (select r.id, 0.85*((select coalesce(sum(pr),0) from k{k-1} where id not in (select i from o))*r + coalesce(x,0)) + 0.15*r as pr
          from r left join (select j, sum(pr*v/s) x from a join o using (i) join k{k-1} on k{k-1}.id = i group by 1) p on p.j = r.id)""")
    return "with " + ", ".join(ctes) + f" select id, round(pr, 9) as pr from k{steps}"


@query("", pr_sql(4))
def pagerank(t):
    li = t.read("lineitem")
    n = li.agg(F.max("l_suppkey") + 1).first()[0]
    a = li.filter("l_suppkey % 9 <> 0").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % n).alias("j")).agg(F.sum("l_quantity").alias("v"))
    ids = li.select(F.col("l_suppkey").alias("id")).distinct()
    r = ids.crossJoin(F.broadcast(ids.agg((1.0 / F.count("*")).alias("pr"))))  # one row
    return X.pagerank(a, r, 0.85, 4).select("id", F.round("pr", 9).alias("pr"))
