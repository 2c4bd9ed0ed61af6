"""Row-oriented matrix scaling, filtering, similarity and itemsets; column keys may be terms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.ranges import rank_in_group, running, top_k
from ..core.session import cut

FEW = 50_000   # query entries that go to every task; a task holds its rows' pairs with their queries
ROOTS = {"SQRT": 0.5, "POW25": 0.25, "POW65": 0.65, "POW75": 0.75, "POW85": 0.85}  # fixed exponents


def normalize(a: DataFrame, by: str = "i", norm: int = 2) -> DataFrame:
    """Divide by the L1 (signed) or L2 norm of the row or column where that is positive."""
    s = a.groupBy(by).agg(F.sum("v" if norm == 1 else F.col("v") * F.col("v")).alias("_s"))
    size = F.col("_s") if norm == 1 else F.sqrt("_s")
    return a.join(s, by).select("i", "j", F.when(F.col("_s") > 0, F.col("v") / size).otherwise(F.col("v")).alias("v"))


def scale(a: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """Term weighting: MAXTF, MAXTF2, SQRT, POW25/65/75/85, LOG, IDF, IDF2."""
    v = F.col("v")
    if kind in ("MAXTF", "MAXTF2"):
        lo, hi = (0.5, 0.5) if kind == "MAXTF" else (0.1, 0.9)
        top = a.groupBy("i").agg(F.max(F.abs("v")).alias("_m"))
        return a.join(top, "i").select("i", "j", (lo + hi * v / F.col("_m")).alias("v"))
    if kind in ROOTS:
        return a.withColumn("v", F.when(v != 0, 0.1 + F.signum(v) * F.pow(F.abs(v), ROOTS[kind])).otherwise(v))
    if kind == "LOG":
        return a.withColumn("v", F.when(v != 0, 1 + F.signum(v) * F.log2(F.abs(v))).otherwise(v))
    df = a.groupBy("j").agg(F.count("*").alias("_df"))
    n = F.lit(rows) if rows is not None else None
    if n is None:
        a = a.crossJoin(F.broadcast(a.agg(F.count_distinct("i").alias("_n"))))  # one row
        n = F.col("_n")
    if kind == "IDF":
        return a.join(df, "j").select("i", "j", (v * F.log(n / F.col("_df"))).alias("v"))
    sizes = df.agg(F.greatest(F.lit(10), F.floor(F.sum("_df") * 0.5 / F.count("*"))).alias("_b"))  # one row
    return a.join(df, "j").crossJoin(F.broadcast(sizes)).select(
        "i", "j", (v * F.log((n + 2 * F.col("_b")) / (F.col("_b") + F.col("_df")))).alias("v"))


# filters --------------------------------------------------------------------------------

def prune(a: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """Keep rows or columns whose entry count lies in [low, high]."""
    n = a.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n").between(low, high))
    return a.join(n.select(by), by, "left_semi").select("i", "j", "v")


def low_filter(a: DataFrame, by: str, norm: int, fraction: float) -> DataFrame:
    """Largest entries first while the sum before an entry is at most fraction * total."""
    other = "j" if by == "i" else "i"
    w = F.col("v") if norm == 1 else F.col("v") * F.col("v")
    run = running(a, [by], [F.col("v").desc(), F.col(other)], {"_run": w})
    total = a.groupBy(by).agg(F.sum(w).alias("_t"))
    return run.join(total, by).filter(F.col("_run") - w <= fraction * F.col("_t")).select("i", "j", "v")


def top_k_plus(a: DataFrame, by: str, k: int, keep: float) -> DataFrame:
    """The k largest per row or column, and every further entry of at least ``keep``."""
    other = "j" if by == "i" else "i"
    first = top_k(a, [by], [F.col("v").desc(), F.col(other)], k, "_r").select("i", "j", "v")
    return first.unionByName(a.filter(F.col("v") >= keep).select("i", "j", "v")).distinct()


def z_score_filter(a: DataFrame, z: float) -> DataFrame:
    """v > z / entries in the row."""
    n = a.groupBy("i").agg(F.count("*").alias("_n"))
    return a.join(n, "i").filter(F.col("v") > F.lit(z) / F.col("_n")).select("i", "j", "v")


def compact_columns(a: DataFrame) -> DataFrame:
    """Renumber non-empty columns by falling frequency (ties by column)."""
    n = a.groupBy("j").agg(F.count("*").alias("_n"))
    ids = rank_in_group(n, [], [F.col("_n").desc(), F.col("j")], "_new")
    return a.join(ids.select("j", "_new"), "j").select("i", F.col("_new").alias("j"), "v")


def extract_rows(a: DataFrame, rows: DataFrame) -> DataFrame:
    return a.join(rows.select(F.col("id").alias("i")), "i", "left_semi")


def row_slice(a: DataFrame, start: int, count: int) -> DataFrame:
    """Contiguous rows, renumbered from 0."""
    return a.filter(F.col("i").between(start, start + count - 1)).withColumn("i", F.col("i") - start)


def partition_rows(a: DataFrame, part: DataFrame, pid: int) -> DataFrame:
    return a.join(part.filter(F.col("part") == pid).select(F.col("id").alias("i")), "i", "left_semi")


def split_by_color(a: DataFrame, color: Column) -> DataFrame:
    """Entries tagged with their colour; write with ``partitionBy("color")`` for one table each."""
    return a.withColumn("color", color)


# similarity ---------------------------------------------------------------------------------

def similar_rows(a: DataFrame, queries: DataFrame, top: int, kind: str = "COS", min_sim: float = 0.0) -> DataFrame:
    """Best rows of ``a`` for each query row q of ``queries(q, j, v)``.

    COS is the dot product (rows are taken as unit length), JAC divides by the remaining squared norms, MIN and
    AMIN use minima. Nothing pairs rows of ``a`` with each other. Up to ``FEW`` query entries go to every task, where
    ``a`` is dealt by row, so terms of a (q, i) are summed where they are made. More of them meet ``a`` in an
    inverted-index join on the shared columns, and sums merge in a shuffle.
    """
    if kind in ("COS", "JAC"):
        term, mass = F.col("v") * F.col("_q"), lambda c: c * c
    else:
        term, mass = F.least("v", "_q"), lambda c: c
    asked = queries.select("q", "j", F.col("v").alias("_q"))
    few = asked.limit(FEW + 1).count() <= FEW
    near = F.broadcast if few else (lambda df: df)
    if few:
        a = a.repartition("i")
    dots = a.join(near(asked), "j").groupBy("q", "i").agg(F.sum(term).alias("s"))
    if kind != "COS":
        qn = queries.groupBy("q").agg(F.sum(mass(F.col("v"))).alias("_qn"))
        dots = dots.join(near(qn), "q")
        if kind == "AMIN":
            sim = F.col("s") / F.col("_qn")
        else:
            dots = dots.join(a.groupBy("i").agg(F.sum(mass(F.col("v"))).alias("_rn")), "i")
            sim = F.col("s") / (F.col("_rn") + F.col("_qn") - F.col("s"))
    else:
        sim = F.col("s")
    scored = dots.select("q", "i", sim.alias("sim")).filter(F.col("sim") >= min_sim)
    return top_k(scored, ["q"], [F.col("sim").desc(), F.col("i")], top)


def pair_similarity(a: DataFrame, pairs: DataFrame, kind: str = "COS") -> DataFrame:
    """(i1, i2, sim) for given row pairs; whole rows count, also past the shorter one's end."""
    if kind in ("COS", "JAC"):
        term, mass = F.col("v") * F.col("_w"), F.col("v") * F.col("v")
    else:
        term, mass = F.least("v", "_w"), F.col("v")
    shared = pairs.join(a.withColumnRenamed("i", "i1"), "i1").join(
        a.select(F.col("i").alias("i2"), "j", F.col("v").alias("_w")), ["i2", "j"]).groupBy("i1", "i2").agg(F.sum(term).alias("s"))
    size = a.groupBy("i").agg(F.sum(mass).alias("n"))
    out = pairs.join(shared, ["i1", "i2"], "left").join(
        size.select(F.col("i").alias("i1"), F.col("n").alias("n1")), "i1", "left").join(
        size.select(F.col("i").alias("i2"), F.col("n").alias("n2")), "i2", "left").na.fill(0.0, ["s", "n1", "n2"])
    s, n1, n2 = F.col("s"), F.col("n1"), F.col("n2")
    den = {"COS": F.sqrt(n1 * n2), "JAC": n1 + n2 - s, "MIN": n1 + n2 - s, "AMIN": n1}[kind]
    return out.select("i1", "i2", F.when(den > 0, s / den).otherwise(0.0).alias("sim"))


# itemsets -------------------------------------------------------------------------------------

def frequent_itemsets(baskets: DataFrame, min_freq: int, max_freq: int = -1, min_len: int = 1,
                      max_len: int = -1) -> DataFrame:
    """(items ARRAY sorted, freq) of baskets(tid, item); -1 means unbounded.

    Level by level: a basket's frequent k-sets grow by its later frequent items, and a set is
    counted only if it extends a frequent one, so no basket ever lists all its subsets. Stops
    at the first empty level.
    """
    b = baskets.select("tid", "item").distinct()
    single = b.groupBy("item").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_freq)
    if max_freq >= 0:
        # columns above the ceiling are dropped before the search, as published
        single = single.filter(F.col("freq") <= max_freq)
    items = cut(b.join(single.select("item"), "item", "left_semi"))
    level = items.select("tid", F.array("item").alias("items"), F.col("item").alias("last"))
    counts = single.select(F.array("item").alias("items"), "freq")
    out, k = (counts if min_len <= 1 else None), 1
    while max_len < 0 or k < max_len:
        k += 1
        grown = level.join(items, "tid").filter(F.col("item") > F.col("last")).select(
            "tid", F.concat("items", F.array("item")).alias("items"), F.col("item").alias("last"))
        counts = cut(grown.groupBy("items").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_freq))
        if counts.limit(1).count() == 0:
            break
        if k >= min_len:
            out = counts if out is None else out.unionAll(counts)
        level = cut(grown.join(counts.select("items"), "items", "left_semi"))
    return out if out is not None else counts


def pagerank(a: DataFrame, restart: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(id, pr): damping * (pushed + sink mass * restart) + (1 - damping) * restart."""
    scale_ = a.groupBy("i").agg(F.sum("v").alias("_s")).filter("_s > 0")
    step = a.join(scale_, "i").select("i", "j", (F.col("v") / F.col("_s")).alias("p"))
    live = scale_.select(F.col("i").alias("id"), F.lit(True).alias("_live"))
    r = restart.select("id", F.col("pr").alias("r"))
    pr = r.join(live, "id", "left").select("id", "r", "_live", F.col("r").alias("pr"))
    for k in range(1, rounds + 1):
        pushed = step.join(pr.select(F.col("id").alias("i"), "pr"), "i").groupBy(F.col("j").alias("id")).agg(
            F.sum(F.col("pr") * F.col("p")).alias("_in"))
        sink = pr.agg(F.coalesce(F.sum(F.when(F.col("_live").isNull(), F.col("pr"))), F.lit(0.0)).alias("_sink"))  # one row
        pr = pr.join(pushed, "id", "left").crossJoin(F.broadcast(sink)).select("id", "r", "_live", (
            damping * (F.col("_sink") * F.col("r") + F.coalesce("_in", F.lit(0.0))) + (1 - damping) * F.col("r")).alias("pr"))
        if k % 3 == 0:
            pr = cut(pr)
    return pr.select("id", "pr")
