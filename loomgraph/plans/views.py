"""Canonical graph, matrix, event and point tables over the input tables.

Each view exists twice: as a DataFrame and as the same SQL text for the oracle.
Supplier s becomes node 2s and part p node 2p+1, so ids never collide at any scale.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.edges import both_ways

# Event types in order, their codes are the positions.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def sp(self) -> DataFrame:
        """supplier -> part, weight = ordered quantity"""
        return self.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.sum("l_quantity").alias("w")).select(
            (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "w")

    @cached_property
    def spu(self) -> DataFrame:
        return both_ways(self.sp)

    @cached_property
    def sp_nodes(self) -> DataFrame:
        s = self.read("supplier").select(
            (F.col("s_suppkey") * 2).alias("id"), F.lit(0).alias("kind"),
            F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("x"),
            (F.col("s_nationkey") % 3).alias("y"))
        p = self.read("part").select(
            (F.col("p_partkey") * 2 + 1).alias("id"), F.lit(1).alias("kind"),
            F.array(F.col("p_retailprice") / 1000, F.col("p_size").cast("double")).alias("x"),
            (F.col("p_size") % 3).alias("y"))
        return s.unionAll(p)

    @cached_property
    def g(self) -> Graph:
        """undirected supplier-part graph with two features per node"""
        return Graph(self.sp_nodes, self.spu, 2)

    @cached_property
    def lines(self) -> DataFrame:
        """many small graphs: one per order, a node per line number"""
        return self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"),
            F.max("l_suppkey").alias("s")).select(
            F.col("l_orderkey").alias("graph_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.array("q", F.col("t") * 100).alias("x"),
            (F.col("s") % 4).cast("int").alias("y"))

    @cached_property
    def line_edges(self) -> DataFrame:
        """consecutive and next-but-one lines of an order, both ways"""
        n = self.lines.select("graph_id", "id", F.col("x")[0].alias("q"))
        hops = n.select("graph_id", F.col("id").alias("src"), F.col("q").alias("qs"),
                        F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("dst"))
        far = n.select("graph_id", F.col("id").alias("dst"), F.col("q").alias("qd"))
        one = hops.join(far, ["graph_id", "dst"]).select(
            "src", "dst", (F.abs(F.col("qs") - F.col("qd")) + 1.0).alias("w"))
        return both_ways(one)

    @cached_property
    def b(self) -> Graph:
        return Graph(self.lines, self.line_edges, 2)

    @cached_property
    def ev(self) -> DataFrame:
        """event stream: user -> event type"""
        code = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
        return self.read("events").select(
            F.col("event_id").alias("e_id"), (F.col("user_id") * 2).alias("src"),
            (code * 2 + 1).cast("bigint").alias("dst"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("msg"))

    @cached_property
    def pts(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
            F.col("label").alias("y"))

    @cached_property
    def m(self) -> DataFrame:
        """supplier x part quantity matrix"""
        return self.read("lineitem").groupBy(
            F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(
            F.sum("l_quantity").alias("v"))

    @cached_property
    def tm(self) -> DataFrame:
        """document x term counts"""
        words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("j")
        return self.read("documents").select(F.col("doc_id").alias("i"), words).filter(
            "j <> ''").groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it needs, SQL)
    "sp": ("", "select 2*l_suppkey as src, 2*l_partkey+1 as dst, sum(l_quantity) as w from lineitem group by 1, 2"),
    "spu": ("sp", "select src, dst, w from sp union all select dst, src, w from sp"),
    "spn": ("", """select 2*s_suppkey as id, 0 as kind, s_acctbal/1000 as x0, s_nationkey::double as x1,
        s_nationkey % 3 as y from supplier union all
        select 2*p_partkey+1, 1, p_retailprice/1000, p_size::double, p_size % 3 from part"""),
    "ln": ("", """select l_orderkey as graph_id, 8*l_orderkey+l_linenumber as id, sum(l_quantity) as x0,
        max(l_tax)*100 as x1, (max(l_suppkey) % 4)::int as y from lineitem group by l_orderkey, l_linenumber"""),
    "le1": ("ln", """select a.id as src, b.id as dst, abs(a.x0-b.x0)+1.0 as w from ln a join ln b
        on a.graph_id = b.graph_id and b.id between a.id+1 and a.id+2"""),
    "le": ("le1", "select src, dst, w from le1 union all select dst, src, w from le1"),
    "ev": ("", """select event_id as e_id, 2*user_id as src,
        (2*(list_position(['click','error','purchase','signup','view'], event_type)-1)+1)::bigint as dst,
        epoch_us(ts) as t, value as msg from events"""),
    "pts": ("", "select vec_id as id, embedding::double[] as x, label as y from embeddings"),
    "m": ("", "select l_suppkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by 1, 2"),
    "tm": ("", """select doc_id as i, j, count(*)::double as v from
        (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as j from documents)
        where j <> '' group by 1, 2"""),
    # normalised propagation weights on the supplier-part graph, loops completed with 1
    "spl": ("spu spn", "select src, dst, w from spu where src <> dst union all select id, id, 1.0 from spn"),
    "gcn": ("spl", """select e.src, e.dst, e.w/sqrt(a.d*b.d) as w from spl e
        join (select dst, sum(w) d from spl group by 1) a on a.dst = e.src
        join (select dst, sum(w) d from spl group by 1) b on b.dst = e.dst"""),
    # the same without loops
    "adj": ("spu", """select e.src, e.dst, e.w/sqrt(a.d*b.d) as w from spu e
        join (select dst, sum(w) d from spu group by 1) a on a.dst = e.src
        join (select dst, sum(w) d from spu group by 1) b on b.dst = e.dst"""),
}


def with_views(names: str, sql: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0].split():
            need(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    ctes = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):].strip()}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:].strip()}"
    return f"with {ctes} {body}"
