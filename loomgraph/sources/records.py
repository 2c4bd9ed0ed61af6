"""Records of several lines (molecules) and files with a header (meshes), read split by split.

Molecule files are cut at their record separator by Spark's text source, which gives a record to the
split it starts in. Mesh files are read line by line; the header, a few lines, goes to the driver and
its counts tell by line number what a line is.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.ranges import global_index
from ..core.session import cut
from .text import numbered_lines, words, write_lines

# Elements in the order of their one-hot places.
ELEMENTS = ["H", "C", "N", "O", "F"]
MOST_ATOMS = 999      # three digits hold a count
HEADER_LINES = 1000   # a longer mesh header is refused


def _field(line: Column, k: int) -> Column:
    """Number ``k`` of a line of three-character fields, or of free words where the fields don't hold."""
    fixed = lambda n: F.trim(F.substr(line, F.lit(3 * n + 1), F.lit(3)))
    holds = fixed(0).rlike(r"^\d+$") & fixed(1).rlike(r"^\d+$") & ((F.lit(k) < 2) | fixed(k).rlike(r"^\d+$"))
    return F.when(holds, fixed(k)).otherwise(F.get(words(line), F.lit(k))).cast("bigint")


def read_sdf(spark: SparkSession, path: str, elements: Sequence[str] = ELEMENTS, line_end: str = "\n") -> tuple[DataFrame, DataFrame]:
    """(nodes(graph_id, id, pos, x, title), edges(src, dst, kind, graph_id)) of the molecules at ``path``.

    Molecules count from 0 in file order, atoms from 0 in each. ``x`` is one-hot over ``elements``, all
    zero for others. Bonds go both ways, ``kind`` is the bond type less one, summed over repeated bonds.
    A last molecule without a separator counts, blank records don't, nor do records without a counts line.
    """
    raw = spark.read.option("lineSep", f"$$$${line_end}").text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    body = raw.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").withColumn("value", F.regexp_replace("value", r"\$\$\$\$\s*$", ""))
    records = global_index(body, [F.col("f"), F.col("b"), F.col("m")], "graph_id").select("graph_id", F.split("value", r"\r?\n").alias("l"))
    head = F.get("l", F.lit(3))
    sized = cut(records.select("graph_id", "l", _field(head, 0).cast("int").alias("n"), _field(head, 1).cast("int").alias("m")))
    atoms = sized.select("graph_id", F.trim(F.get("l", F.lit(0))).alias("title"), F.posexplode(F.slice("l", F.lit(5), F.col("n"))).alias("id", "line"))
    w = words("line")
    nodes = atoms.select("graph_id", F.col("id").cast("bigint").alias("id"), F.slice(w, 1, 3).cast("array<double>").alias("pos"),
                         F.array(*[(F.get(w, F.lit(3)) == e).cast("double") for e in elements]).alias("x"), "title")
    bonds = sized.select("graph_id", F.explode(F.slice("l", F.col("n") + 5, F.col("m"))).alias("line")).select(
        "graph_id", (_field(F.col("line"), 0) - 1).alias("a"), (_field(F.col("line"), 1) - 1).alias("b"), (_field(F.col("line"), 2) - 1).alias("kind"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    edges = bonds.select("graph_id", "kind", ends.alias("e")).groupBy("graph_id", "e.src", "e.dst").agg(F.sum("kind").alias("kind"))
    return nodes, edges.select("src", "dst", "kind", "graph_id")


def write_sdf(atoms: DataFrame, bonds: DataFrame, path: str) -> None:
    """Molecules from atoms(graph_id, id, pos, symbol) and bonds(graph_id, src, dst, kind), each bond once.

    A molecule is one record of at most 999 atoms and 999 bonds, what the format can number; more raise,
    as do coordinates that would touch their neighbour. Coordinates keep four decimals.
    """
    three = lambda c: F.lpad(c.cast("string"), 3, " ")
    shown = lambda k: F.format_string("%10.4f", F.col("pos")[k])
    place = lambda k: F.when(F.length(F.trim(shown(k))) < 10, shown(k)).otherwise(F.raise_error(F.lit("a coordinate does not fit its ten characters")))
    a = atoms.select("graph_id", "id", F.concat(place(0), place(1), place(2), F.lit(" "), F.rpad("symbol", 3, " "), F.lit(" 0" + "  0" * 11)).alias("s"))
    b = bonds.select("graph_id", "src", "dst", F.concat(three(F.col("src") + 1), three(F.col("dst") + 1), three(F.col("kind") + 1), F.lit("  0")).alias("s"))
    texts = lambda c: F.transform(F.array_sort(c), lambda r: r["s"])
    both = a.groupBy("graph_id").agg(texts(F.collect_list(F.struct("id", "s"))).alias("atoms")).join(
        b.groupBy("graph_id").agg(texts(F.collect_list(F.struct("src", "dst", "s"))).alias("bonds")), "graph_id", "left")
    bonds_of = F.coalesce("bonds", F.array().cast("array<string>"))
    fits = (F.size("atoms") <= MOST_ATOMS) & (F.size(bonds_of) <= MOST_ATOMS)
    counts = F.when(fits, F.concat(three(F.size("atoms")), three(F.size(bonds_of)), F.lit("  0  0  0  0  0  0  0  0999 V2000"))).otherwise(
        F.raise_error(F.lit(f"a molecule has more than {MOST_ATOMS} atoms or bonds")))
    lines = F.concat(F.array(F.col("graph_id").cast("string"), F.lit(""), F.lit(""), counts), F.col("atoms"), bonds_of, F.array(F.lit("M  END"), F.lit("$$$$")))
    write_lines(both.select(F.col("graph_id").alias("ord"), F.array_join(lines, "\n").alias("value")), path)


def fans(corners: DataFrame) -> DataFrame:
    """(a, b, c) triangles around the first corner of each polygon(corners)."""
    k = F.explode(F.when(F.size("corners") >= 3, F.sequence(F.lit(1), F.size("corners") - 2)))
    return corners.select("corners", k.alias("k")).select(
        F.col("corners")[0].alias("a"), F.get("corners", F.col("k")).alias("b"), F.get("corners", F.col("k") + 1).alias("c"))


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, pos), faces(a, b, c)) of an ASCII mesh file; polygons become fans, other elements and
    properties are passed over. Binary files raise."""
    lines = cut(numbered_lines(spark, path))
    last = lines.filter(F.trim("value") == "end_header").agg(F.min("line")).first()[0]
    if last is None or last > HEADER_LINES:
        raise ValueError("no mesh header")
    header = [r["value"].split() for r in lines.filter(F.col("line") <= last).orderBy("line").collect()]   # HEADER_LINES at most
    if not any(h[:2] == ["format", "ascii"] for h in header):
        raise ValueError("only ASCII mesh files are read")
    first, spans, properties = last + 1, {}, {}
    for h in header:
        if h[:1] == ["element"]:
            spans[h[1]], properties[h[1]] = (first, first + int(h[2])), []
            first += int(h[2])
        elif h[:1] == ["property"]:
            properties[list(spans)[-1]].append((h[-1], h[1] == "list"))
    part = lambda name: lines.filter(F.col("line").between(spans[name][0], spans[name][1] - 1)).withColumn("w", words())
    at = {name: k for k, (name, _) in enumerate(properties["vertex"])}
    nodes = part("vertex").select((F.col("line") - spans["vertex"][0]).alias("id"), F.array(*[F.col("w")[at[c]].cast("double") for c in "xyz"]).alias("pos"))
    if "face" not in spans:
        return nodes, spark.createDataFrame([], "a bigint, b bigint, c bigint")
    start = F.lit(1)   # lists and plain numbers before the corners shift them from line to line
    for name, is_list in properties["face"]:
        if name.startswith("vertex_ind"):
            break
        start = start + 1 + (F.element_at("w", start).cast("int") if is_list else 0)
    corners = part("face").select(F.slice("w", start + 1, F.element_at("w", start).cast("int")).cast("array<bigint>").alias("corners"))
    return nodes, fans(corners)


def _mesh_lines(nodes: DataFrame, faces: DataFrame, head: list[str], path: str) -> None:
    n, h = nodes.count(), len(head)
    v = nodes.select((F.col("id") + h).alias("ord"), F.array_join(F.col("pos").cast("array<string>"), " ").alias("value"))
    f = faces.select((F.col("id") + n + h).alias("ord"), F.concat_ws(" ", F.size("corners").cast("string"), F.array_join(F.col("corners").cast("array<string>"), " ")).alias("value"))
    top = nodes.sparkSession.createDataFrame(list(enumerate(head)), "ord bigint, value string")
    write_lines(top.unionByName(v).unionByName(f), path)


def write_ply(nodes: DataFrame, faces: DataFrame, path: str) -> None:
    """ASCII mesh from nodes(id, pos) and faces(id, corners), both numbered from 0 without gaps."""
    _mesh_lines(nodes, faces, ["ply", "format ascii 1.0", f"element vertex {nodes.count()}", "property double x", "property double y", "property double z",
                               f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"], path)


def write_off(nodes: DataFrame, faces: DataFrame, path: str) -> None:
    """Mesh with a counts line, from nodes(id, pos) and faces(id, corners), both numbered from 0 without gaps."""
    _mesh_lines(nodes, faces, ["OFF", f"{nodes.count()} {faces.count()} 0"], path)


def write_dense(a: DataFrame, nrow: int, ncol: int, path: str) -> None:
    """Every cell of (i, j, v), column by column, cells without an entry as 0."""
    spark = a.sparkSession
    cells = spark.range(nrow * ncol).withColumnRenamed("id", "cell").join(
        a.groupBy((F.col("j") * nrow + F.col("i")).alias("cell")).agg(F.sum("v").alias("v")), "cell", "left")
    body = cells.select((F.col("cell") + 2).alias("ord"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).cast("string").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix array real general"), (1, f"{nrow} {ncol}")], "ord bigint, value string")
    write_lines(head.unionByName(body), path)


def write_csr(a: DataFrame, nrow: int, ncol: int, path: str, values: bool = True, base: int = 1, header: bool = True) -> None:
    """One line of "col [val]" groups per row of (i, j, v), blank for rows without entries."""
    spark = a.sparkSession
    cell = F.concat_ws(" ", (F.col("j") + base).cast("string"), *([F.col("v").cast("double").cast("string")] if values else []))
    rows = a.groupBy(F.col("i").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", cell.alias("s")))), lambda r: r["s"]), " ").alias("value"))
    body = spark.range(nrow).join(rows, "id", "left").select((F.col("id") + 1).alias("ord"), F.coalesce("value", F.lit("")).alias("value"))
    if header:
        body = spark.createDataFrame([(0, f"{nrow} {ncol} {a.count()}")], "ord bigint, value string").unionByName(body)
    write_lines(body, path)
