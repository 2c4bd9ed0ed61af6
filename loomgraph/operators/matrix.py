"""Sparse matrices as coordinate tables (i, j, v); dense ones are the same with every cell."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.ranges import running
from .edges import both_ways

EPS = 2.220446049250313e-16  # double precision unit round-off
PACK = 1024              # entries of a column in one array, about
TASK_TERMS = 8_000_000   # terms of a product that a task makes, about
MOST_TASKS = 100_000


def _swap(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


# construction ------------------------------------------------------------------------

def speye(spark: SparkSession, n: int, ncol: int | None = None) -> DataFrame:
    return spark.range(min(n, ncol or n)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def spzeros(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "i bigint, j bigint, v double")


def full(spark: SparkSession, nrow: int, ncol: int, v: float) -> DataFrame:
    """Dense constant, column by column: one range, no product of tables."""
    return spark.range(nrow * ncol).select(
        (F.col("id") % nrow).alias("i"), F.floor(F.col("id") / nrow).alias("j"), F.lit(float(v)).alias("v"))


def eye(spark: SparkSession, nrow: int, ncol: int) -> DataFrame:
    return full(spark, nrow, ncol, 0.0).withColumn("v", (F.col("i") == F.col("j")).cast("double"))


def sum_duplicates(t: DataFrame) -> DataFrame:
    """Triplets to a matrix."""
    return t.groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_dense(a: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """(i, row ARRAY) for every row, zeros filled in: runs of zeros between the sorted entries."""
    entries = F.map_entries(F.map_from_entries(F.collect_list(F.struct("j", "v"))))   # a map: an entry comes once
    rows = a.groupBy("i").agg(F.array_sort(F.filter(entries, lambda e: (e["key"] >= 0) & (e["key"] < ncol))).alias("m"))
    none = F.array().cast("array<bigint>")
    js, end = F.coalesce(F.transform("m", lambda e: e["key"].cast("bigint")), none), F.lit(ncol).cast("bigint")
    gaps = F.zip_with(F.concat(F.array(F.lit(-1).cast("bigint")), js), F.concat(js, F.array(end)), lambda j, k: (k - j - 1).cast("int"))
    each = F.coalesce(F.transform("m", lambda e: F.array(F.coalesce(e["value"], F.lit(0.0)))), F.array().cast("array<array<double>>"))
    last = F.array(F.array().cast("array<double>"))
    return a.sparkSession.range(nrow).select(F.col("id").alias("i")).join(rows, "i", "left").select(
        "i", F.flatten(F.zip_with(gaps, F.concat(each, last), lambda n, v: F.concat(F.array_repeat(F.lit(0.0), n), v))).alias("row"))


def drop_zeros(a: DataFrame) -> DataFrame:
    return a.filter("v <> 0")


def symmetric_half_to_full(a: DataFrame) -> DataFrame:
    """Stored triangle to both halves."""
    return a.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "v"))).otherwise(F.array(
        F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")))).alias("e")).select("e.*")


def triangle(a: DataFrame, upper: bool = True) -> DataFrame:
    return a.filter("i <= j" if upper else "i >= j")


# algebra ------------------------------------------------------------------------------

def transpose(a: DataFrame) -> DataFrame:
    return _swap(a)


def permute(a: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """A(P, Q): perm tables (pos, id) say which old index sits at each place; unlisted ids drop."""
    out = a
    for p, c in ((rows, "i"), (cols, "j")):
        if p is not None:
            out = out.join(p.select(F.col("id").alias(c), F.col("pos").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select("i", "j", "v")


def ptranspose(a: DataFrame, perm: DataFrame | None = None, fset: DataFrame | None = None) -> DataFrame:
    """A(P, f)' : rows permuted, columns limited to ``fset(id)``, transposed."""
    out = permute(a, rows=perm)
    if fset is not None:
        out = out.join(fset.select(F.col("id").alias("j")), "j", "left_semi")
    return _swap(out)


def ptranspose_symmetric(upper: DataFrame, perm: DataFrame) -> DataFrame:
    """Permute a stored upper triangle and return the lower one of A(P, P)'."""
    p = permute(upper, perm, perm)
    return p.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B over the union of the patterns."""
    return sum_duplicates(a.select("i", "j", (F.col("v") * alpha).alias("v")).unionAll(
        b.select("i", "j", (F.col("v") * beta).alias("v"))))


def band(a: DataFrame, k1: int, k2: int, mode: int = 1) -> DataFrame:
    """Entries with k1 <= j - i <= k2; mode 0 pattern only, below 0 also without diagonal."""
    out = a.filter(F.col("j") - F.col("i") >= k1).filter(F.col("j") - F.col("i") <= k2)
    if mode < 0:
        out = out.filter("i <> j")
    return out if mode > 0 else out.select("i", "j")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B. Partial sums combine map-side before the (i, j) shuffle."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("_a")).join(
        b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b")), "k").groupBy("i", "j").agg(
        F.sum(F.col("_a") * F.col("_b")).alias("v"))


def sdmult(a: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0,
           transposed: bool = False) -> DataFrame:
    """alpha op(A) X + beta Y with dense tables (i, c, v)."""
    m = _swap(a) if transposed else a
    prod = m.join(x.select(F.col("i").alias("j"), "c", F.col("v").alias("_x")), "j").groupBy("i", "c").agg(
        (F.sum(F.col("v") * F.col("_x")) * alpha).alias("v"))
    if y is None or beta == 0:
        return prod
    return prod.unionByName(y.select("i", "c", (F.col("v") * beta).alias("v"))).groupBy("i", "c").agg(F.sum("v").alias("v"))


def _column_pairs(m: DataFrame) -> DataFrame:
    """(a, b): entry structs of each column's pairs, a.i <= b.i (null rows first), equal rows both ways.

    Columns are packed into arrays of about ``PACK`` entries, a crowded one into several that meet in a join, and laid
    out by their smallest row: columns of near rows lie in one task, where their terms merge before any shuffle. Tasks
    are as many as the terms ask for.
    """
    m = m.filter("j is not null")
    rest = [c for c in m.columns if c != "j"]
    n = m.groupBy("j").agg(F.count("*").alias("n"))
    terms, most = n.agg(F.sum(F.col("n").cast("double") * F.col("n")) / 2, F.max("n")).first()
    tasks = int(min(max((terms or 0) // TASK_TERMS + 1, m.sparkSession.sparkContext.defaultParallelism), MOST_TASKS))
    if (most or 0) <= PACK:
        packed = m.groupBy("j").agg(F.collect_list(F.struct(*rest)).alias("a"))
        pairs = packed.select("j", F.lit(0).alias("p"), F.lit(0).alias("q"), "a", F.col("a").alias("b"))
    else:
        packed = m.join(n, "j").groupBy("j", F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / PACK)).alias("p")).agg(
            F.collect_list(F.struct(*rest)).alias("a"))
        pairs = packed.join(packed.select("j", F.col("p").alias("q"), F.col("a").alias("b")), "j")
    low = F.array_min(F.transform("a", lambda e: e["i"]))
    laid = pairs.repartitionByRange(tasks, low, F.col("j"), F.col("p"), F.col("q"))
    pairs = laid.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return pairs.filter(F.col("a.i").isNull() | (F.col("a.i") <= F.col("b.i")))


def aat(a: DataFrame, fset: DataFrame | None = None, mode: int = 1) -> DataFrame:
    """A(:, f) A(:, f)'; mode as in ``band``. Half of the product is made and mirrored, without values
    where only the pattern is asked for."""
    m = a if fset is None else a.join(fset.select(F.col("id").alias("j")), "j", "left_semi")
    pairs = _column_pairs(m.select("i", "j", "v") if mode > 0 else m.select("i", "j"))
    keys = [F.col("a.i").alias("i"), F.col("b.i").alias("j")]
    if mode > 0:
        half = pairs.groupBy(*keys).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
    else:
        half = pairs.select(*keys)
        half = (half.filter("i <> j") if mode < 0 else half).distinct()
    rest = half.columns[2:]
    here, there = F.struct("i", "j", *rest), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *rest)
    return half.select(F.explode(F.when(F.col("i").eqNullSafe(F.col("j")), F.array(here)).otherwise(F.array(here, there))).alias("e")).select("e.*")


# norms and summaries --------------------------------------------------------------------

def nnz(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("nnz"))


def norm(a: DataFrame, kind: str = "inf") -> DataFrame:
    """"inf" max row sum of |v|, "1" max column sum, "2" root of the sum of squares (vectors)."""
    if kind == "2":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return a.groupBy("i" if kind == "inf" else "j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def max_col_norm(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("s")).agg(
        F.coalesce(F.sqrt(F.max("s")), F.lit(0.0)).alias("norm"))


def rank_tolerance(a: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """20 (m + n) eps max column norm (1 where that norm is 0)."""
    return max_col_norm(a).select((F.lit(20.0 * (nrow + ncol) * EPS) * F.when(
        F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("tol"))


def prefix_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exclusive running sum along ``key``."""
    out = running(df.select(key, value), [], [F.col(key)], {"p": F.col(value)})
    return out.select(key, (F.col("p") - F.col(value)).alias("p"))


def sums(a: DataFrame, by: str = "i", squared: bool = False) -> DataFrame:
    return a.groupBy(by).agg(F.sum(F.col("v") * F.col("v") if squared else F.col("v")).alias("s"))


def symmetry(a: DataFrame) -> DataFrame:
    """Matched off-diagonal entries, entries off the diagonal, diagonal entries, symmetry share."""
    off = a.filter("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") < F.col("j")).alias("up")).distinct()
    pairs = off.groupBy("a", "b").agg(F.count("*").alias("n"))
    diag = a.filter("i = j").select("i").distinct().agg(F.count("*").alias("diag"))
    s = pairs.agg(F.coalesce(F.sum(F.when(F.col("n") == 2, 2).otherwise(0)), F.lit(0)).alias("matched"),
                  F.coalesce(F.sum("n"), F.lit(0)).alias("off"))
    return s.crossJoin(diag).select("matched", "off", "diag", F.when(  # two one-row tables
        F.col("off") > 0, F.col("matched") / F.col("off")).otherwise(1.0).alias("symmetry"))


def pattern_of_sum(a: DataFrame) -> DataFrame:
    """Off-diagonal pattern of A + A', both halves."""
    return both_ways(a.filter("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))).distinct()


# structural features ------------------------------------------------------------------------

def node_features(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, id, rdeg, cdeg, eli_add) per node of each matrix.

    ``eli_add`` counts fill edges of eliminating k: rdeg * cdeg minus the stored entries (u, w)
    with u -> k -> w. Counted by closing each wedge with an entry; entries (u, u) count when u
    is both an in- and an out-neighbour. ``a`` has graph_id, i, j.
    """
    off = a.filter("i <> j").select("graph_id", "i", "j")
    rdeg = off.groupBy("graph_id", F.col("i").alias("id")).agg(F.count("*").alias("rdeg"))
    cdeg = off.groupBy("graph_id", F.col("j").alias("id")).agg(F.count("*").alias("cdeg"))
    # entries (u, w) meet the edges leaving u, then must find k -> w: joins on stored entries only
    reach = a.select("graph_id", F.col("i").alias("u"), F.col("j").alias("w")).join(
        off.select("graph_id", F.col("i").alias("u"), F.col("j").alias("k")), ["graph_id", "u"])
    closed = reach.join(off.select("graph_id", F.col("i").alias("k"), F.col("j").alias("w")), ["graph_id", "k", "w"]).groupBy(
        "graph_id", F.col("k").alias("id")).agg(F.count("*").alias("shut"))
    out = nodes.select("graph_id", "id")
    for t in (rdeg, cdeg, closed):
        out = out.join(t, ["graph_id", "id"], "left")
    out = out.na.fill(0, ["rdeg", "cdeg", "shut"])
    return out.select("graph_id", "id", "rdeg", "cdeg", (F.col("rdeg") * F.col("cdeg") - F.col("shut")).alias("eli_add"))


def graph_info(a: DataFrame, features: DataFrame) -> DataFrame:
    """Per matrix: size, density, average degree, shares at the maximum degree, extremes.

    The minimum starts at 999, as published, so it never exceeds that.
    """
    n = a.groupBy("graph_id").agg(F.count("*").alias("nnz"))
    top = features.groupBy("graph_id").agg(
        F.count("*").alias("n"), F.sum("rdeg").alias("s"), F.max("rdeg").alias("max_rdeg"), F.max("cdeg").alias("max_cdeg"),
        F.least(F.min("rdeg"), F.lit(999)).alias("min_rdeg"), F.least(F.min("cdeg"), F.lit(999)).alias("min_cdeg"))
    at = features.join(top, "graph_id").groupBy("graph_id").agg(
        F.count_if(F.col("rdeg") == F.col("max_rdeg")).alias("r"), F.count_if(F.col("cdeg") == F.col("max_cdeg")).alias("c"))
    return top.join(n, "graph_id").join(at, "graph_id").select(
        "graph_id", "n", "nnz", (F.col("nnz") / (F.col("n").cast("double") * F.col("n"))).alias("density"),
        (F.col("s") / F.col("n")).alias("avg_rdeg"), (F.col("r") / F.col("n")).alias("max_rdeg_share"),
        (F.col("c") / F.col("n")).alias("max_cdeg_share"), "max_rdeg", "min_rdeg", "max_cdeg", "min_cdeg")


def scaled_features(features: DataFrame) -> DataFrame:
    """Each feature over (its maximum in the matrix + 1)."""
    cols = ["rdeg", "cdeg", "eli_add"]
    top = features.groupBy("graph_id").agg(*[F.max(c).alias(f"_{c}") for c in cols])
    return features.join(top, "graph_id").select("graph_id", "id", *[
        (F.col(c) / (F.col(f"_{c}") + 1)).alias(c) for c in cols])


# validation: one row of counts, all zero when sound ----------------------------------------------

def check_sparse(a: DataFrame, nrow: int, ncol: int) -> DataFrame:
    bounds = a.agg(F.count_if((F.col("i") < 0) | (F.col("i") >= nrow) | (F.col("j") < 0) | (F.col("j") >= ncol)).alias("out_of_range"),
                   F.count_if(F.col("v").isNull() | F.isnan("v")).alias("bad_values"))
    dup = a.groupBy("i", "j").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return bounds.crossJoin(dup)  # two one-row tables


def check_perm(p: DataFrame, n: int) -> DataFrame:
    seen = p.groupBy("id").count()
    return seen.agg(F.count_if((F.col("id") < 0) | (F.col("id") >= n)).alias("out_of_range"),
                    F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"),
                    (F.lit(n) - F.count("*")).alias("missing"))


def check_subset(s: DataFrame, n: int) -> DataFrame:
    return s.agg(F.count_if((F.col("id") < 0) | (F.col("id") >= n)).alias("out_of_range"))


def check_parent(p: DataFrame) -> DataFrame:
    """(id, parent) in elimination numbering: a parent comes after its child (-1 for roots)."""
    return p.agg(F.count_if((F.col("parent") != -1) & (F.col("parent") <= F.col("id"))).alias("not_after"))


def check_factor(l: DataFrame, n: int) -> DataFrame:
    """Lower triangular with a full positive diagonal."""
    return l.agg(F.count_if(F.col("i") < F.col("j")).alias("above_diagonal"),
                 (F.lit(n) - F.count_if((F.col("i") == F.col("j")) & (F.col("v") > 0))).alias("bad_diagonal"))


def rcond(l: DataFrame, ll: bool = True) -> DataFrame:
    """min / max of the diagonal (squared for LL'); 0 when undefined."""
    d = F.when(F.col("i") == F.col("j"), F.abs("v"))
    return l.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.count_if(F.isnan("v") & (F.col("i") == F.col("j"))).alias("bad")).select(
        F.when((F.col("bad") > 0) | (F.coalesce("hi", F.lit(0.0)) == 0), 0.0).otherwise(
            F.pow(F.col("lo") / F.col("hi"), 2 if ll else 1)).alias("rcond"))


def ldl_to_ll(l: DataFrame) -> DataFrame:
    """Unit L with D on the diagonal to L L' form: column j times sqrt(d_j)."""
    d = l.filter("i = j").select("j", F.sqrt("v").alias("_r"))
    return l.join(d, "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("_r")).otherwise(F.col("v") * F.col("_r")).alias("v"))


def ll_to_ldl(l: DataFrame) -> DataFrame:
    d = l.filter("i = j").select("j", F.col("v").alias("_r"))
    return l.join(d, "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") * F.col("v")).otherwise(F.col("v") / F.col("_r")).alias("v"))


# scalars -------------------------------------------------------------------------------------------

def hypot(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def divide_complex(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    """struct(re, im) of a / b, scaled by the larger part of b against overflow."""
    wide = F.abs(br) >= F.abs(bi)
    r = F.when(wide, bi / br).otherwise(br / bi)
    den = F.when(wide, br + r * bi).otherwise(r * br + bi)
    return F.struct((F.when(wide, ar + ai * r).otherwise(ar * r + ai) / den).alias("re"),
                    (F.when(wide, ai - ar * r).otherwise(ai * r - ar) / den).alias("im"))
