"""Edge-table rewrites: loops, symmetry, isolation, subgraphs, relabelling, densifying."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import mix
from ..core.ranges import rank_in_group
from ..core.session import cut


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def node_count(edges: DataFrame) -> DataFrame:
    """One row: max id + 1."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("n"))


def node_count_by_type(edges: DataFrame) -> DataFrame:
    """max id + 1 per node type of typed edges."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")),
        F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id")))).alias("e"))
    return ends.groupBy("e.type").agg((F.max("e.id") + 1).alias("n"))


# loops -----------------------------------------------------------------------

def contains_self_loops(edges: DataFrame) -> DataFrame:
    return edges.agg((F.count_if(F.col("src") == F.col("dst")) > 0).alias("has_loops"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def segregate_self_loops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges.filter("src <> dst"), edges.filter("src = dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """Append one loop per node; loops already there stay."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(fill).alias("w"))
    return edges.select("src", "dst", "w").unionAll(loops)


def add_remaining_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """Exactly one loop per node; the last existing loop lends its weight."""
    last = F.max_by("w", "e_id") if "e_id" in edges.columns else F.max("w")
    old = edges.filter("src = dst").groupBy(F.col("src").alias("id")).agg(last.alias("lw"))
    loops = nodes.select("id").join(old, "id", "left").select(
        F.col("id").alias("src"), F.col("id").alias("dst"),
        F.coalesce("lw", F.lit(fill)).alias("w"))
    return edges.filter("src <> dst").select("src", "dst", "w").unionAll(loops)


# symmetry and duplicates -------------------------------------------------------

def coalesce_edges(edges: DataFrame) -> DataFrame:
    """Merge parallel edges, summing weights."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst", "dst": "src"}).select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, in one pass over the input."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(F.array(
        F.struct("src", "dst"),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"),
        *rest).select("e.src", "e.dst", *rest)


def to_undirected(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("src", "dst")).distinct()


def to_undirected_weighted(edges: DataFrame) -> DataFrame:
    """Symmetrise and carry the weights along (summed where both directions exist)."""
    return coalesce_edges(both_ways(edges.select("src", "dst", "w")))


def is_undirected(edges: DataFrame) -> DataFrame:
    """One boolean row: the coalesced edge set equals its transpose, weights included."""
    signed = edges.select(F.explode(F.array(
        F.struct("src", "dst", F.lit(1).alias("n"), F.col("w").alias("v")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("n"),
                 (-F.col("w")).alias("v")))).alias("e"))
    # presence per direction, not multiplicity: parallel edges merge first
    pair = signed.groupBy("e.src", "e.dst").agg(
        F.max((F.col("e.n") > 0).cast("int")).alias("here"),
        F.max((F.col("e.n") < 0).cast("int")).alias("there"), F.sum("e.v").alias("gap"))
    bad = (F.col("here") != F.col("there")) | (F.abs("gap") > 1e-9)
    return pair.agg((F.count_if(bad) == 0).alias("undirected"))


def sort_edge_index(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def to_sparse_rows(edges: DataFrame) -> DataFrame:
    """Transposed compressed-row layout: partitioned by target, sorted inside."""
    return edges.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src")


def is_coalesced(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").count().agg(
        (F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("coalesced"))


# isolation and relabelling -----------------------------------------------------

def linked_nodes(edges: DataFrame) -> DataFrame:
    return endpoints(remove_self_loops(edges)).distinct()


def contains_isolated_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    linked = linked_nodes(edges).agg(F.count("*").alias("n_linked"))
    return nodes.agg(F.count("*").alias("n")).crossJoin(linked).select(  # two one-row tables
        (F.col("n_linked") < F.col("n")).alias("isolated"))


def relabel_map(ids: DataFrame) -> DataFrame:
    """(id, new_id) with new ids 0..k-1 in id order."""
    return rank_in_group(ids.select("id"), [], [F.col("id")], "new_id")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite both endpoints through (id, new_id); edges with an unmapped end drop."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    s = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("_s"))
    d = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("_d"))
    return edges.join(s, "src").join(d, "dst").select(
        F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)


def remove_isolated_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): linked nodes renumbered; one loop kept per surviving node."""
    mapping = relabel_map(linked_nodes(edges))
    last = F.max_by("w", "e_id") if "e_id" in edges.columns else F.max("w")
    loops = edges.filter("src = dst").groupBy("src", "dst").agg(last.alias("w"))
    kept = remove_self_loops(edges).select("src", "dst", "w").unionAll(loops)
    return relabel(kept, mapping), mapping


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node rows (with every attribute) that keep at least one neighbour."""
    return nodes.join(linked_nodes(edges), "id", "left_semi")


# selection ---------------------------------------------------------------------

def filter_edges(edges: DataFrame, mask: Column) -> DataFrame:
    return edges.filter(mask)


def index_to_mask(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(id, mask): whether the id is listed."""
    marked = index.select("id").distinct().withColumn("_m", F.lit(True))
    return nodes.select("id").join(marked, "id", "left").select(
        "id", F.col("_m").isNotNull().alias("mask"))


def subgraph(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges with both ends in ``subset(id)``."""
    ids = subset.select("id").distinct()
    return (edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
            .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
            .select(*edges.columns))


def subgraph_relabelled(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """As ``subgraph``, renumbered by the order given in ``subset(id, pos)``."""
    return relabel(edges, subset.select("id", F.col("pos").alias("new_id")))


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, hops: int,
                flow: str = "source_to_target") -> DataFrame:
    """(id, hop): ids reached against the message flow, with their distance."""
    near, far = ("dst", "src") if flow == "source_to_target" else ("src", "dst")
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("next")).distinct()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = (front.join(step, "id").select(F.col("next").alias("id")).distinct()
                 .join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if hops > 1:
            front = cut(front)
        seen = seen.unionAll(front)
    return seen


def k_hop_subgraph(edges: DataFrame, seeds: DataFrame, hops: int,
                   flow: str = "source_to_target") -> tuple[DataFrame, DataFrame]:
    """(nodes with hop and new_id in id order, induced edges)."""
    reached = cut(k_hop_nodes(edges, seeds, hops, flow))
    named = reached.join(relabel_map(reached), "id")
    return named, subgraph(edges, reached)


def dropout_edges(edges: DataFrame, p: float, seed: int = 0, undirected: bool = False) -> DataFrame:
    """Drop each edge with probability ``p``; undirected drops both directions together."""
    keep = mix.unit("src", "dst", seed=seed) >= p
    if not undirected:
        return edges.filter(keep)
    return both_ways(edges.filter((F.col("src") < F.col("dst")) & keep))


# typed graphs --------------------------------------------------------------------

def group_hetero(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fuse typed tables into one id space.

    ``nodes(type, id)`` and ``edges(src_type, rel, dst_type, src, dst)``; offsets add up
    over the sorted types. Returns nodes(id, type, local_id), edges(src, dst, rel).
    """
    from pyspark.sql import Window
    sizes = nodes.groupBy("type").agg((F.max("id") + 1).alias("n"))
    # one row per node type: a handful, whatever the size of the graph
    before = Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    fused = nodes.join(F.broadcast(offset), "type").select(
        (F.col("id") + F.col("off")).alias("id"), "type", F.col("id").alias("local_id"))
    so = offset.select(F.col("type").alias("src_type"), F.col("off").alias("_so"))
    do = offset.select(F.col("type").alias("dst_type"), F.col("off").alias("_do"))
    linked = edges.join(F.broadcast(so), "src_type").join(F.broadcast(do), "dst_type").select(
        (F.col("src") + F.col("_so")).alias("src"), (F.col("dst") + F.col("_do")).alias("dst"), "rel")
    return fused, linked


# dense forms -----------------------------------------------------------------------

def local_index(nodes: DataFrame) -> DataFrame:
    """(graph_id, id, pos): position of each node in its graph."""
    return rank_in_group(nodes.select("graph_id", "id"), ["graph_id"], [F.col("id")], "pos")


def to_dense_batch(nodes: DataFrame, value: str, fill: float = 0.0,
                   size: int | None = None) -> DataFrame:
    """(graph_id, pos, value, mask): every graph padded to ``size`` rows."""
    placed = cut(rank_in_group(nodes.select("graph_id", "id", value), ["graph_id"],
                               [F.col("id")], "pos"))
    most = (placed.agg(F.max("pos")).first()[0] or 0) + 1
    if size is None:
        size = most
    elif most > size:
        raise ValueError(f"a graph has {most} nodes, more than {size}")
    grid = placed.select("graph_id").distinct().select(
        "graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("pos"))
    return grid.join(placed, ["graph_id", "pos"], "left").select(
        "graph_id", "pos", F.coalesce(value, F.lit(fill)).alias(value),
        F.col("id").isNotNull().alias("mask"))


def to_dense_adj(nodes: DataFrame, edges: DataFrame, size: int | None = None) -> DataFrame:
    """(graph_id, i, row ARRAY<DOUBLE>): one dense adjacency row per padded node."""
    place = cut(local_index(nodes))
    most = (place.agg(F.max("pos")).first()[0] or 0) + 1
    if size is None:
        size = most
    elif most > size:
        raise ValueError(f"a graph has {most} nodes, more than {size}")
    s = place.select(F.col("id").alias("src"), "graph_id", F.col("pos").alias("i"))
    d = place.select(F.col("id").alias("dst"), F.col("pos").alias("j"))
    cells = edges.join(s, "src").join(d, "dst").groupBy("graph_id", "i", "j").agg(
        F.sum("w").alias("w"))
    rows = cells.groupBy("graph_id", "i").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    grid = place.select("graph_id").distinct().select(
        "graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("i"))
    cols = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    return grid.join(rows, ["graph_id", "i"], "left").select(
        "graph_id", "i",
        F.transform(cols, lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("row"))


def dense_to_sparse(rows: DataFrame) -> DataFrame:
    """(.., i, row ARRAY) -> one edge per non-zero cell."""
    rest = [c for c in rows.columns if c not in ("i", "row")]
    return rows.select(*rest, F.col("i").alias("src"), F.posexplode("row").alias("dst", "w")).filter(
        "w <> 0").withColumn("dst", F.col("dst").cast("bigint"))


def edges_from_adjacency(adjacency: DataFrame) -> DataFrame:
    """(id, neighbours ARRAY) -> distinct edges."""
    return adjacency.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")).distinct()


def repeat_to_length(values: Sequence | float | None, length: int) -> list | None:
    """Pad by the last value (or spread a scalar) to ``length``."""
    if values is None:
        return None
    if not isinstance(values, (list, tuple)):
        return [values] * length
    return list(values[:length]) + [values[-1]] * max(0, length - len(values))
