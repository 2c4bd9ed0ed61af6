"""Components, orders, paths, matchings, partitions and their quality, as rounds of joins.

``edges`` are undirected graphs stored in both directions unless said otherwise. Each round
is a join and a map-side-combined aggregate, cut to storage so neither plan nor lineage grows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import mix
from ..core.ranges import global_index, rank_in_group, running, top_k
from ..core.session import cut, release
from .edges import both_ways, coalesce_edges, relabel
from .pool import dominant_matching, matching_clusters, pool_edge


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, comp): smallest id of the component.

    Alternates hooking to the smallest neighbouring label with pointer jumping, so long paths
    take a logarithmic number of rounds.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    lab = old = cut(nodes.select("id", F.col("id").alias("comp")))
    for _ in range(max_rounds):
        near = e.join(lab.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("m"))
        # a node's better label also becomes its current root's: hook roots, then jump
        best = lab.join(near, "id", "left").select("id", "comp", F.least("comp", F.coalesce("m", "comp")).alias("m"))
        hook = best.groupBy(F.col("comp").alias("id")).agg(F.min("m").alias("h"))
        merged = best.join(hook.select(F.col("id").alias("comp"), "h"), "comp").select("id", F.col("comp").alias("was"), F.least("m", "h").alias("comp"))
        jump = merged.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        nxt = cut(merged.join(jump, "comp", "left").select("id", "was", F.coalesce("up", "comp").alias("comp")))
        changed = nxt.filter("was <> comp").limit(1).count()
        release(old)
        lab, old = nxt.select("id", "comp"), nxt
        if not changed:
            break
    release(e)
    return lab


def partition_components(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(id, part, comp): components of the graph cut at part borders."""
    inner = edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("_a")), "src").join(
        part.select(F.col("id").alias("dst"), F.col("part").alias("_b")), "dst").filter("_a = _b")
    return part.join(components(inner, part), "id")


def is_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return components(edges, nodes).agg((F.count_distinct("comp") <= 1).alias("connected"))


def bfs_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level) of everything reachable from ``roots(id)``."""
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(roots.select("id").distinct().withColumn("level", F.lit(0)))
    front, level = seen, 0
    while True:
        level += 1
        front = cut(front.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct().join(
            seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if front.limit(1).count() == 0:
            release(e)
            return seen
        seen = seen.unionAll(front)
        if level % 8 == 0:
            seen = cut(seen)


def bfs_ordering(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level, pos): breadth-first numbering, ids ascending inside a level."""
    return global_index(bfs_levels(edges, roots), [F.col("level"), F.col("id")], "pos")


def shortest_paths(edges: DataFrame, nodes: DataFrame, root: int, max_rounds: int = 10000) -> DataFrame:
    """(id, dist) over non-negative weights; unreached nodes read -1. Only improved nodes push."""
    e = cut(edges.groupBy("src", "dst").agg(F.min("w").alias("w")))
    dist = cut(nodes.select("id", F.when(F.col("id") == root, 0.0).alias("dist"), (F.col("id") == root).alias("hot")))
    for _ in range(max_rounds):
        reach = dist.filter("hot").select(F.col("id").alias("src"), "dist").join(e, "src").groupBy(F.col("dst").alias("id")).agg(
            F.min(F.col("dist") + F.col("w")).alias("d"))
        better = F.col("d").isNotNull() & (F.col("dist").isNull() | (F.col("d") < F.col("dist")))
        dist = cut(dist.join(reach, "id", "left").select("id", F.when(better, F.col("d")).otherwise(F.col("dist")).alias("dist"), F.coalesce(better, F.lit(False)).alias("hot")))
        if dist.filter("hot").limit(1).count() == 0:
            break
    return dist.select("id", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def best_first_waves(edges: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """(id, level, pos): best-first order by waves: among a wave's nodes those with most links to
    nodes already placed go first (a whole wave is placed at once)."""
    lev = cut(bfs_levels(edges, nodes.filter(F.col("id") == root)))
    near = edges.select("src", "dst").join(lev.select(F.col("id").alias("src"), F.col("level").alias("_a")), "src").join(
        lev.select(F.col("id").alias("dst"), F.col("level").alias("_b")), "dst").filter("_a < _b").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links"))
    return global_index(lev.join(near, "id", "left").na.fill(0, ["links"]), [F.col("level"), F.col("links").desc(), F.col("id")], "pos")


# matchings and coarsening ------------------------------------------------------------------------------

def _halves(edges: DataFrame) -> DataFrame:
    return edges.filter("src < dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def heavy_edge_matching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): heaviest edges first, ties by ids."""
    return matching_clusters(dominant_matching(_halves(edges), nodes, [(-F.col("w")).alias("neg")]), nodes)


def random_matching(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(id, cluster): edges in a drawn order."""
    return matching_clusters(dominant_matching(_halves(edges), nodes, [mix.mix("src", "dst", seed=seed).alias("h")]), nodes)


def coarsen_graph(edges: DataFrame, nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes(id, vwgt), map(id, coarse)) after ``levels`` heavy-edge contractions."""
    e = coalesce_edges(edges.filter("src <> dst").select("src", "dst", "w"))
    n = nodes.select("id", (F.col("vwgt") if "vwgt" in nodes.columns else F.lit(1)).alias("vwgt"))
    names = n.select("id", F.col("id").alias("coarse"))
    for _ in range(levels):
        c = cut(heavy_edge_matching(e, n))
        e = cut(pool_edge(e, c.withColumnRenamed("cluster", "new_id")))
        n = cut(n.join(c, "id").groupBy(F.col("cluster").alias("id")).agg(F.sum("vwgt").alias("vwgt")))
        names = cut(names.join(c.select(F.col("id").alias("coarse"), "cluster"), "coarse").select("id", F.col("cluster").alias("coarse")))
    return e, n, names


# partitioning --------------------------------------------------------------------------------------------

def partition_kway(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = 6, slack: float = 1.03,
                   levels: int = 2, seed: int = 0) -> DataFrame:
    """(id, part): multilevel k-way partition.

    Coarsen by heavy-edge matching; number the coarse graph breadth-first and slice it by
    weight into k parts; then move border nodes to the part they are tied to most. A round
    moves only nodes that win their part's remaining room in order of gain, so the balance
    bound slack * total / k (plus one node) holds throughout.
    """
    e0 = cut(edges.select("src", "dst", "w"))
    ce, cn, names = coarsen_graph(e0, nodes, levels)
    total = cn.agg(F.sum("vwgt")).first()[0]
    order = _breadth_order(ce, cn)
    run = running(order.join(cn, "id"), [], [F.col("pos")], {"upto": F.col("vwgt")})
    coarse = run.select(F.col("id").alias("coarse"), F.least(F.floor((F.col("upto") - F.col("vwgt")) * k / total), F.lit(k - 1)).cast("int").alias("part"))
    part = cut(names.join(coarse, "coarse").select("id", "part"))
    w = nodes.select("id", (F.col("vwgt") if "vwgt" in nodes.columns else F.lit(1)).alias("vwgt"))
    room = slack * total / k
    for r in range(rounds):
        part = cut(_refine(e0, part, w, room, r, seed))
    return part


def _breadth_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos): breadth-first positions, component by component from its smallest id."""
    comp = cut(components(edges, nodes))
    lev = bfs_levels(edges, comp.select(F.col("comp").alias("id")).distinct())
    return global_index(comp.join(lev, "id"), [F.col("comp"), F.col("level"), F.col("id")], "pos").select("id", "pos")


def _refine(edges: DataFrame, part: DataFrame, w: DataFrame, room: float, r: int, seed: int) -> DataFrame:
    tie = edges.join(part.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").groupBy(
        F.col("src").alias("id"), "to").agg(F.sum("w").alias("pull"))
    own = part.join(tie, "id").groupBy("id", "part").agg(
        F.sum(F.when(F.col("to") == F.col("part"), F.col("pull")).otherwise(0.0)).alias("stay"),
        F.max_by(F.struct("to", "pull"), F.when(F.col("to") != F.col("part"), F.struct("pull", -F.col("to")))).alias("b"))
    # half of the nodes may move in a round, so neighbours do not swap places
    wish = own.filter((F.col("b.to") != F.col("part")) & (F.col("b.pull") > F.col("stay")) & (F.pmod(mix.mix("id", F.lit(r), seed=seed), F.lit(2)) == 0)).select(
        "id", F.col("b.to").alias("to"), (F.col("b.pull") - F.col("stay")).alias("gain")).join(w, "id")
    load = part.join(w, "id").groupBy(F.col("part").alias("to")).agg((F.lit(room) - F.sum("vwgt")).alias("free"))
    run = running(wish, ["to"], [F.col("gain").desc(), F.col("id")], {"upto": F.col("vwgt")})
    moved = run.join(load, "to", "left").filter(F.col("upto") <= F.coalesce("free", F.lit(room))).select("id", "to")
    return part.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part"))


def partition_recursive(edges: DataFrame, nodes: DataFrame, levels: int, rounds: int = 3) -> DataFrame:
    """(id, part): 2^levels parts by repeated bisection; all pieces of a level split together.

    Each piece is ordered breadth-first inside itself and cut at half its weight.
    """
    w = nodes.select("id", (F.col("vwgt") if "vwgt" in nodes.columns else F.lit(1)).alias("vwgt"))
    part = nodes.select("id", F.lit(0).alias("part"))
    for _ in range(levels):
        part = cut(part)
        inner = edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("_a")), "src").join(
            part.select(F.col("id").alias("dst"), F.col("part").alias("_b")), "dst").filter("_a = _b").select("src", "dst", "w")
        order = _breadth_order(inner, part)
        run = running(part.join(order, "id").join(w, "id"), ["part"], [F.col("pos")], {"upto": F.col("vwgt")})
        half = part.join(w, "id").groupBy("part").agg((F.sum("vwgt") / 2).alias("half"))
        part = run.join(half, "part").select("id", (F.col("part") * 2 + (F.col("upto") - F.col("vwgt") >= F.col("half")).cast("int")).alias("part"))
    return part


def vertex_separator(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(id, part): part 2 separates parts 0 and 1.

    The ends of cut edges in the side with fewer such ends form the separator; a node whose
    cut edges all lead to separator nodes returns to its side.
    """
    a = part.select(F.col("id").alias("src"), F.col("part").alias("_a"))
    b = part.select(F.col("id").alias("dst"), F.col("part").alias("_b"))
    cross = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").filter("_a <> _b"))
    side = cross.groupBy("_a").agg(F.count_distinct("src").alias("n")).orderBy("n", "_a").limit(1)  # one of two rows
    sep = cross.join(F.broadcast(side.select("_a")), "_a").select(F.col("src").alias("id")).distinct().withColumn("_s", F.lit(True))
    return part.join(sep, "id", "left").select("id", F.when(F.col("_s"), 2).otherwise(F.col("part")).alias("part"))


def refine_separator(edges: DataFrame, part: DataFrame, rounds: int = 2) -> DataFrame:
    """Move separator nodes that touch only one side into it.

    Separator nodes linked to each other may not leave together on opposite sides: only the
    smallest id among linked leavers goes in a round.
    """
    for _ in range(rounds):
        part = cut(part)
        near = edges.select("src", "dst").join(part.filter("part = 2").select(F.col("id").alias("src")), "src", "left_semi").join(
            part.select(F.col("id").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.max((F.col("part") == 0).cast("int")).alias("l"), F.max((F.col("part") == 1).cast("int")).alias("r"))
        free = near.filter("l + r < 2").select("id", F.when(F.col("r") == 1, 1).otherwise(0).alias("to"))
        linked = edges.select("src", "dst").join(free.select(F.col("id").alias("src")), "src", "left_semi").join(
            free.select(F.col("id").alias("dst")), "dst", "left_semi").filter("dst < src").select(F.col("src").alias("id")).distinct()
        go = free.join(linked, "id", "left_anti")
        part = part.join(go, "id", "left").select("id", F.coalesce("to", "part").alias("part"))
    return part


# partition quality -------------------------------------------------------------------------------------------

def partition_balance(nodes: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """k * heaviest part / total."""
    w = F.col("vwgt") if "vwgt" in nodes.columns else F.lit(1)
    per = nodes.join(part, "id").groupBy("part").agg(F.sum(w).alias("s"))
    return per.agg((F.lit(k) * F.max("s") / F.sum("s")).alias("balance"))


def subdomain_graph(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edge weight between each two parts."""
    return pool_edge(edges, part.withColumnRenamed("part", "new_id"))


def partition_cut(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Cut weight (each undirected edge once) and communication volume."""
    e = edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("_a")), "src").join(
        part.select(F.col("id").alias("dst"), F.col("part").alias("_b")), "dst").filter("_a <> _b")
    vol = e.select("src", "_b").distinct().agg(F.count("*").alias("volume"))
    return e.agg((F.coalesce(F.sum("w"), F.lit(0.0)) / 2).alias("cut")).crossJoin(vol)  # two one-row tables


# graph table upkeep -----------------------------------------------------------------------------------------------

def check_graph(edges: DataFrame) -> DataFrame:
    """Loops, repeated edges, and edges whose reverse is missing or differs in weight."""
    ahead = F.coalesce(F.col("src") <= F.col("dst"), F.lit(True))
    rows = edges.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("b"), "w", ahead.alias("f"))
    # dealt once by pair; both aggregates keep that layout
    twin = rows.repartition("a", "b").groupBy("a", "b", "w").agg(F.count_if("f").alias("f"), F.count_if(~F.col("f")).alias("g"))
    loop, known = F.col("a") == F.col("b"), F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("w").isNotNull()
    lone = F.when(~known, F.col("f") + F.col("g")).when(loop | ((F.col("f") > 0) & (F.col("g") > 0)), 0).otherwise(F.col("f") + F.col("g"))
    pair = twin.groupBy("a", "b").agg(F.sum("f").alias("f"), F.sum("g").alias("g"), F.sum(lone).alias("lone"))
    more = F.greatest(F.col("f") - 1, F.lit(0)) + F.greatest(F.col("g") - 1, F.lit(0))
    return pair.agg(F.coalesce(F.sum(F.when(loop, F.col("f"))), F.lit(0)).alias("loops"), F.coalesce(F.sum(more), F.lit(0)).alias("repeated"),
                    F.coalesce(F.sum("lone"), F.lit(0)).alias("unmatched"))


def fix_graph(edges: DataFrame) -> DataFrame:
    """Loops out, both directions present, one edge per pair with the larger weight."""
    return both_ways(edges.filter("src <> dst").select("src", "dst", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def normalize_weights(edges: DataFrame, by: str = "src", norm: int = 1) -> DataFrame:
    s = edges.groupBy(by).agg(F.sum("w" if norm == 1 else F.col("w") * F.col("w")).alias("_s"))
    size = F.col("_s") if norm == 1 else F.sqrt("_s")
    return edges.join(s, by).select("src", "dst", F.when(F.col("_s") > 0, F.col("w") / size).otherwise(F.col("w")).alias("w"))


def prune_by_degree(edges: DataFrame, by: str, low: int, high: int) -> DataFrame:
    n = edges.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n").between(low, high))
    return edges.join(n.select(by), by, "left_semi").select("src", "dst", "w")


def reorder(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """Apply perm(id, pos)."""
    return relabel(edges, perm.select("id", F.col("pos").alias("new_id")))


def id_range(edges: DataFrame, start: int, count: int) -> DataFrame:
    """Induced subgraph of a contiguous id range, renumbered from 0."""
    inside = F.col("src").between(start, start + count - 1) & F.col("dst").between(start, start + count - 1)
    return edges.filter(inside).select((F.col("src") - start).alias("src"), (F.col("dst") - start).alias("dst"), "w")


# meshes: elements(elem, node) ----------------------------------------------------------------------------------------

SMALL_ELEMENT = 16   # an element of up to this many nodes is written as its node pairs


def mesh_to_dual(elements: DataFrame, common: int) -> DataFrame:
    """Element pairs sharing at least ``common`` nodes, or all but one node of either.

    Where one shared node is enough the pairs of a node are the result. Where two or more are asked, small
    elements meet on pairs of nodes, which far fewer elements share than single nodes, so pairs with one node in
    common are never written; pairs with a larger element are counted over single nodes.
    """
    plain = elements.select("elem", "node").distinct()
    size = plain.groupBy("elem").agg(F.count("*").alias("n"))
    m = cut(plain.join(size, "elem").withColumn("t", F.greatest(F.lit(1), F.least(F.lit(max(common, 1)), F.col("n") - 1))))
    far = m.select("node", F.col("elem").alias("other"), F.col("n").alias("_n"), F.col("t").alias("_t"))
    both = F.array(F.struct(F.col("elem").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("elem").alias("dst")))
    easy = m.filter("t = 1").join(far, "node").filter((F.col("elem") < F.col("other")) | (F.col("elem") > F.col("other")) & (F.col("_t") > 1))
    pairs = easy.select("elem", "other").distinct()
    if common > 1:
        hard = m.filter("t > 1")
        large = hard.filter(F.col("n") > SMALL_ELEMENT).select("node", "elem", "n", "t")
        wide = large.join(far.filter("_t > 1"), "node").filter((F.col("elem") < F.col("other")) | (F.col("elem") > F.col("other")) & (F.col("_n") <= SMALL_ELEMENT))
        need = F.least("t", "_t")
        met = wide.groupBy("elem", "other").agg(F.count("*").alias("c"), F.min(need).alias("need")).filter("c >= need").select("elem", "other")
        small = hard.filter(F.col("n") <= SMALL_ELEMENT).groupBy("elem").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.min("t").alias("t"))
        two = cut(small.select("elem", "t", F.posexplode("nodes").alias("k", "u"), "nodes").select(
            "elem", "t", "u", F.explode(F.expr("slice(nodes, k + 2, size(nodes))")).alias("v")))
        twin = two.select("u", "v", F.col("elem").alias("other"), F.col("t").alias("_t"))
        # c shared nodes meet c (c - 1) / 2 times
        close = two.join(twin, ["u", "v"]).filter("elem < other").groupBy("elem", "other").agg(
            F.count("*").alias("c"), F.min(need).alias("need")).filter("2 * c >= need * (need - 1)").select("elem", "other")
        pairs = pairs.unionAll(met).unionAll(close)
    return pairs.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def mesh_to_nodal(elements: DataFrame) -> DataFrame:
    """Node pairs that meet in an element."""
    m = elements.select("elem", "node").distinct()
    return m.join(m.select("elem", F.col("node").alias("other")), "elem").filter("node <> other").select(
        F.col("node").alias("src"), F.col("other").alias("dst")).distinct()


def partition_mesh(elements: DataFrame, k: int, common: int = 1, dual: bool = True, rounds: int = 6,
                   levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """(elements(id, part), nodes(id, part)): one side partitioned, the other follows its majority."""
    g = mesh_to_dual(elements, common) if dual else mesh_to_nodal(elements)
    a, b = ("elem", "node") if dual else ("node", "elem")
    ids = elements.select(F.col(a).alias("id")).distinct()
    part = cut(partition_kway(g.withColumn("w", F.lit(1.0)), ids, k, rounds, levels=levels))
    votes = elements.distinct().join(part.select(F.col("id").alias(a), "part"), a).groupBy(F.col(b).alias("id"), "part").agg(F.count("*").alias("n"))
    other = votes.groupBy("id").agg(F.max_by("part", F.struct(F.col("n"), -F.col("part"))).alias("part"))
    return (part, other) if dual else (other, part)
