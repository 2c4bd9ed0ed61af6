"""Tables written in a text format and read back: molecules, meshes, dense and row-wise matrices."""
from pyspark.sql import functions as F

from ..core.ranges import global_index, rank_in_group
from ..core.session import cut, new_folder
from ..sources import records as R
from ..sources import text as S
from .catalog import query

SYMBOLS = [*R.ELEMENTS, "S"]   # one that the reader has no place for

ATOMS = """c as (select distinct l_orderkey as o, l_partkey as p from lineitem),
a as (select o, p, row_number() over (partition by o order by p) - 1 as id from c)"""
MATRIX = "m as (select l_suppkey as i, l_linenumber as j, sum(l_quantity) as v from lineitem group by 1, 2)"


def atoms(t):
    """(o, p, id): the parts of each order, counted from 0"""
    return rank_in_group(t.read("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct(), ["o"], [F.col("p")], "id")


def molecules(t):
    """One molecule per order: its parts as atoms, bonds from part to next part."""
    a = cut(atoms(t))
    part = t.read("part").select(F.col("p_partkey").alias("p"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.5)).alias("pos"))
    nodes = a.join(part, "p").select(F.col("o").alias("graph_id"), "id", "pos", F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("p") % 6 + 1).cast("int")).alias("symbol"))
    after = a.select("o", (F.col("id") - 1).alias("id"), F.col("p").alias("q"))
    bonds = a.join(after, ["o", "id"]).select(F.col("o").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), ((F.col("p") + F.col("q")) % 3).alias("kind"))
    path = new_folder(t.spark)
    R.write_sdf(nodes, bonds, path)
    return R.read_sdf(t.spark, path)


@query(sql=f"""with {ATOMS}
select o as graph_key, id, cast(p_size as double) as px, p_retailprice as py, case when p % 6 < 5 then cast(p % 6 + 1 as bigint) else 0 end as element
from a join part on p = p_partkey""")
def sdf_atoms(t):
    return molecules(t)[0].select(F.col("title").cast("bigint").alias("graph_key"), "id", F.col("pos")[0].alias("px"), F.col("pos")[1].alias("py"),
                                  F.array_position("x", 1.0).cast("bigint").alias("element"))


@query(sql=f"""with {ATOMS},
b as (select a.o, a.id as s, z.id as d, (a.p + z.p) % 3 as kind from a join a z on a.o = z.o and z.id = a.id + 1)
select o as graph_key, s as src, d as dst, kind from b union all select o, d, s, kind from b""")
def sdf_bonds(t):
    nodes, edges = molecules(t)
    return edges.join(nodes.filter("id = 0").select("graph_id", F.col("title").cast("bigint").alias("graph_key")), "graph_id").select("graph_key", "src", "dst", "kind")


def mesh(t, most=None):
    """nodes: parts; faces: the parts of each order as a polygon"""
    nodes = t.read("part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.5)).alias("pos"))
    faces = atoms(t).groupBy("o").agg(F.array_sort(F.collect_list("p")).alias("corners")).filter(F.size("corners") >= 3)
    return nodes, global_index(faces if most is None else faces.filter(F.size("corners") <= most), [F.col("o")], "id").select("id", "corners")


FANS = """select f.p as a, k.p as b, z.p as c, count(*) as n from a f join a k on f.o = k.o and k.id > 0
join a z on z.o = k.o and z.id = k.id + 1 where f.id = 0 {0} group by 1, 2, 3"""


@query(sql=f"with {ATOMS} " + FANS.format(""))
def ply_triangles(t):
    path = new_folder(t.spark)
    R.write_ply(*mesh(t), path)
    return R.read_ply(t.spark, path)[1].groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query(sql="select p_partkey as id, cast(p_size as double) as px, p_retailprice as py, cast(0.5 as double) as pz from part")
def ply_points(t):
    path = new_folder(t.spark)
    R.write_ply(*mesh(t), path)
    return R.read_ply(t.spark, path)[0].select("id", *[F.col("pos")[k].alias(f"p{c}") for k, c in enumerate("xyz")])


@query(sql=f"with {ATOMS}, w as (select o from a group by o having count(*) <= 4) " + FANS.format("and f.o in (select o from w)"))
def off_triangles(t):
    """Triangles and quads only, as the format's reader splits them."""
    path = new_folder(t.spark)
    R.write_off(*mesh(t, most=4), path)
    return S.read_off(t.spark, path)[1].groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def matrix(t):
    """(matrix, rows, columns): quantities by supplier and line number"""
    m = cut(t.read("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.sum("l_quantity").alias("v")))
    n = m.agg(F.max("i"), F.max("j")).first()
    return m, n[0] + 1, n[1] + 1


@query(sql=f"""with {MATRIX},
g as (select i, j from (select unnest(range((select max(i) + 1 from m))) as i) cross join (select unnest(range((select max(j) + 1 from m))) as j))
select g.i, g.j, coalesce(v, 0) as v from g left join m using (i, j)""")
def dense_matrix_file(t):
    m, nrow, ncol = matrix(t)
    path = new_folder(t.spark)
    R.write_dense(m, nrow, ncol, path)
    return S.read_matrix_market(t.spark, path)[0]


@query(sql=f"with {MATRIX} select i, cast(j as bigint) as j, v from m")
def csr_matrix_file(t):
    m, nrow, ncol = matrix(t)
    path = new_folder(t.spark)
    R.write_csr(m, nrow, ncol, path)
    return S.read_csr(t.spark, path)
