"""Readers and writers for matrix, graph and mesh text formats, on Spark's text source.

Formats whose meaning depends on line order get line numbers from (file, split start, row in
split) ranked over a range layout, so large files stay split over many tasks. Compressed
``.gz`` and ``.bz2`` inputs are read as they are.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.ranges import global_index
from ..core.session import cut


@dataclass(frozen=True)
class MatrixMeta:
    nrow: int
    ncol: int
    symmetric: bool
    pattern: bool
    dense: bool


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None, blank: bool = True) -> DataFrame:
    """(line, value): lines numbered from 0 in file order, comment (and blank) lines left out first."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                       F.monotonically_increasing_id().alias("m"))
    if comment:
        raw = raw.filter(~F.ltrim("value").startswith(comment))
    if not blank:
        raw = raw.filter(F.trim("value") != "")
    return global_index(raw, [F.col("f"), F.col("b"), F.col("m")], "line").select("line", "value")


def words(c: str | Column = "value") -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _triangle(cell: Column, n: int) -> tuple[Column, Column]:
    """(i, j) of a running number in a lower triangle of ``n`` columns, column by column."""
    start = lambda j: j * n - F.floor(j * (j - 1) / 2)
    near = F.floor((F.lit(2 * n + 1) - F.sqrt(F.greatest(F.lit(float((2 * n + 1) ** 2)) - 8 * cell, F.lit(0.0)))) / 2).cast("bigint")
    j = F.when(start(near) > cell, near - 1).when(start(near + 1) <= cell, near + 1).otherwise(near)
    return (j + cell - start(j)).cast("bigint"), j.cast("bigint")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """(i, j, v) from a coordinate or array file, 0-based, stored halves expanded; complex files add ``im``.

    Skew-symmetric mirrors change sign, hermitian ones conjugate. Pattern entries read 1; symmetric
    patterns read -1 off the diagonal and 1 + the largest degree on it, as published. Only the banner
    and size line come to the driver; the size line is known by its place.
    """
    banner = [w.lower() for w in spark.read.text(path).filter(F.col("value").startswith("%%")).first()[0].split()]
    dense, pattern = "array" in banner, "pattern" in banner
    skew, hermitian, symmetric = "skew-symmetric" in banner, "hermitian" in banner, "symmetric" in banner
    folded, double = skew or hermitian or symmetric, "complex" in banner or hermitian
    body = cut(numbered_lines(spark, path, "%", blank=False))
    nrow, ncol = (int(w) for w in body.filter("line = 0").first()["value"].split()[:2])
    w, cell = words(), F.col("line") - 1
    if not dense:
        at = [(w[0].cast("bigint") - 1), (w[1].cast("bigint") - 1)]
    elif not folded:
        at = [(cell % nrow), F.floor(cell / nrow)]
    else:
        i, j = _triangle(cell, nrow - 1 if skew else nrow)
        at = [i + 1 if skew else i, j]
    first = 0 if dense else 2
    numbers = [(F.lit(1.0) if pattern else w[first].cast("double")).alias("v")] + ([w[first + 1].cast("double").alias("im")] if double else [])
    a = body.filter("line > 0").select(at[0].alias("i"), at[1].alias("j"), *numbers)
    if symmetric and not dense and not double:
        from ..operators.matrix import symmetric_half_to_full
        a = symmetric_half_to_full(a)
        if pattern:
            deg = a.filter("i <> j").groupBy("i").count().agg((F.coalesce(F.max("count"), F.lit(0)) + 1.0).alias("d"))
            full = a.filter("i <> j").select("i", "j", F.lit(-1.0).alias("v"))
            diag = spark.range(nrow).crossJoin(F.broadcast(deg)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("v"))  # one row
            a = full.unionAll(diag)
    elif folded:
        other = [(-F.col("v") if skew else F.col("v")).alias("v")] + ([(-F.col("im") if skew or hermitian else F.col("im")).alias("im")] if double else [])
        a = a.unionAll(a.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *other))
    return a, MatrixMeta(nrow, ncol, folded, pattern, dense)


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text parts from (ord, value); parts concatenate in name order."""
    lines.orderBy("ord").select("value").write.mode("overwrite").text(path)


def write_matrix_market(a: DataFrame, nrow: int, ncol: int, path: str) -> None:
    n = a.count()
    body = a.select((F.col("j") * nrow + F.col("i") + 2).alias("ord"),
                    F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    spark = a.sparkSession
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{nrow} {ncol} {n}")], "ord bigint, value string")
    write_lines(head.unionByName(body), path)


def read_adjacency_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, vsize, vwgt ARRAY), edges(src, dst, w)) of the adjacency-list format: a header
    "n m [fmt [ncon]]", then one line per vertex, 1-based; '%' starts a comment."""
    lines = cut(numbered_lines(spark, path, "%").withColumn("w", words()))
    head = lines.filter("line = 0").first()["w"]
    fmt = (head[2] if len(head) > 2 else "0").zfill(3)
    ncon = int(head[3]) if len(head) > 3 else (1 if fmt[1] == "1" else 0)
    skip = (1 if fmt[0] == "1" else 0) + (ncon if fmt[1] == "1" else 0)
    v = lines.filter(F.col("line").between(1, int(head[0]))).withColumn("id", F.col("line") - 1)
    sz = F.col("w")[0].cast("bigint") if fmt[0] == "1" else F.lit(1).cast("bigint")
    wt = F.slice("w", 2 if fmt[0] == "1" else 1, ncon).cast("array<bigint>") if fmt[1] == "1" else F.array(F.lit(1).cast("bigint"))
    rest = F.slice("w", skip + 1, F.greatest(F.size("w") - skip, F.lit(0)))
    cells = v.select("id", F.posexplode(rest).alias("p", "x"))
    if fmt[2] == "1":
        pair = v.select("id", rest.alias("r")).select("id", F.explode(F.when(F.size("r") > 0, F.sequence(F.lit(1), F.size("r"), F.lit(2)))).alias("k"), "r")
        edges = pair.select(F.col("id").alias("src"), (F.element_at("r", F.col("k")).cast("bigint") - 1).alias("dst"), F.element_at("r", F.col("k") + 1).cast("double").alias("w"))
    else:
        edges = cells.select(F.col("id").alias("src"), (F.col("x").cast("bigint") - 1).alias("dst"), F.lit(1.0).alias("w"))
    return v.select("id", sz.alias("vsize"), wt.alias("vwgt")), edges


def write_adjacency_graph(edges: DataFrame, n: int, path: str) -> None:
    m = edges.count() // 2
    rows = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list((F.col("dst") + 1))).alias("d"))
    spark = edges.sparkSession
    body = spark.range(n).join(rows, "id", "left").select((F.col("id") + 1).alias("ord"), F.coalesce(F.concat_ws(" ", F.col("d").cast("array<string>")), F.lit("")).alias("value"))
    write_lines(spark.createDataFrame([(0, f"{n} {m}")], "ord bigint, value string").unionByName(body), path)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(elem, node) from an element list: a count line, then node numbers (1-based) per element."""
    return numbered_lines(spark, path, "%").filter("line > 0").select(
        (F.col("line") - 1).alias("elem"), F.explode(words()).alias("n")).select("elem", (F.col("n").cast("bigint") - 1).alias("node"))


def read_csr(spark: SparkSession, path: str, values: bool = True, base: int = 1, header: bool = True) -> DataFrame:
    """(i, j, v) from one row per line of "col [val]" groups."""
    lines = numbered_lines(spark, path)
    lines = lines.filter("line > 0").withColumn("line", F.col("line") - 1) if header else lines
    w = lines.select(F.col("line").alias("i"), words().alias("w"))
    step = 2 if values else 1
    k = w.select("i", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(step)))).alias("k"))
    return k.select("i", (F.element_at("w", F.col("k")).cast("bigint") - base).alias("j"),
                    (F.element_at("w", F.col("k") + 1).cast("double") if values else F.lit(1.0)).alias("v"))


def read_vector(spark: SparkSession, path: str, dtype: str = "bigint") -> DataFrame:
    """(id, value): one value per line (partition, permutation and target-weight files)."""
    return numbered_lines(spark, path).filter("trim(value) <> ''").select(F.col("line").alias("id"), F.trim("value").cast(dtype).alias("value"))


def write_vector(v: DataFrame, path: str) -> None:
    write_lines(v.select(F.col("id").alias("ord"), F.col("value").cast("string").alias("value")), path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, pos), faces(a, b, c)) from "v x y z" and "f i j k" lines."""
    lines = cut(numbered_lines(spark, path, "#").withColumn("w", words()))
    v = global_index(lines.filter("w[0] = 'v'"), [F.col("line")], "id").select("id", F.slice("w", 2, 3).cast("array<double>").alias("pos"))
    f = lines.filter("w[0] = 'f'").select(*[(F.split(F.col("w")[k + 1], "/")[0].cast("bigint") - 1).alias(c) for k, c in enumerate("abc")])
    return v, f


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, pos), faces(a, b, c)); the counts may share the first line; quads split in two."""
    from ..operators.transforms import quads_to_triangles
    lines = cut(numbered_lines(spark, path, "#").filter("trim(value) <> ''").withColumn("w", words()))
    head = lines.filter("line < 2").orderBy("line").select("w").collect()  # two lines
    joined = len(head[0][0]) == 1 and len(head[0][0][0]) == 3
    counts = head[1][0] if joined else ([head[0][0][0][3:]] if head[0][0][0] != "OFF" else []) + list(head[0][0][1:])
    n, skip = int(counts[0]), 2 if joined else 1
    body = lines.withColumn("k", F.col("line") - skip).filter("k >= 0")
    nodes = body.filter(F.col("k") < n).select(F.col("k").alias("id"), F.slice("w", 1, 3).cast("array<double>").alias("pos"))
    corners = body.filter(F.col("k") >= n).select(F.slice("w", 2, F.col("w")[0].cast("int")).cast("array<bigint>").alias("corners"))
    return nodes, quads_to_triangles(corners)


def read_tu(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, graph_id[, label]), edges(src, dst)): loops out, duplicates merged, ids from 0,
    node labels shifted to start at 0."""
    num = lambda part: numbered_lines(spark, f"{folder}/{prefix}_{part}.txt")
    e = spark.read.text(f"{folder}/{prefix}_A.txt").select(F.split("value", r",\s*").alias("w")).select(
        (F.trim(F.col("w")[0]).cast("bigint") - 1).alias("src"), (F.trim(F.col("w")[1]).cast("bigint") - 1).alias("dst"))
    nodes = num("graph_indicator").select(F.col("line").alias("id"), (F.trim("value").cast("bigint") - 1).alias("graph_id"))
    try:
        lab = num("node_labels").select(F.col("line").alias("id"), F.trim("value").cast("bigint").alias("label"))
        low = lab.agg(F.min("label").alias("_l"))  # one row
        nodes = nodes.join(lab.crossJoin(F.broadcast(low)).select("id", (F.col("label") - F.col("_l")).alias("label")), "id")
    except Exception as missing:  # the label file is optional
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    return nodes, e.filter("src <> dst").distinct()


def read_edge_list(spark: SparkSession, path: str, sep: str = ",", names: tuple[str, ...] = ("src", "dst", "w", "t")) -> DataFrame:
    """Delimited edges with as many of the named columns as the lines have."""
    cols = spark.read.csv(path, sep=sep, comment="#").columns
    schema = ", ".join(f"{n} {'double' if n == 'w' else 'bigint'}" for n in names[:len(cols)])
    return spark.read.csv(path, sep=sep, comment="#", schema=schema)


def read_graph_info(spark: SparkSession, path: str) -> DataFrame:
    """Eleven space-separated columns per matrix."""
    return spark.read.csv(path, sep=" ", schema="graph_id bigint, n bigint, nnz bigint, density double, avg_rdeg double, max_rdeg_share double, "
                          "max_cdeg_share double, max_rdeg bigint, min_rdeg bigint, max_cdeg bigint, min_cdeg bigint")


def read_graph_labels(spark: SparkSession, path: str) -> DataFrame:
    w = words(F.regexp_replace("value", "\r", ""))
    return spark.read.text(path).select(w.alias("w")).filter(F.size("w") >= 2).select(F.col("w")[0].cast("bigint").alias("graph_id"), F.col("w")[1].cast("int").alias("label"))
