"""Fill-reducing orders and symbolic analysis by rounds of independent eliminations.

The matrix graph is kept in quotient form: variable-variable edges plus elements, each the
list of variables an eliminated pivot (or a matrix row) ties together. A round eliminates
every variable whose priority is least among all it can reach - they do not touch each
other, so the fill is that of eliminating them one by one. New elements absorb the old ones
they came from or contain, so no clique is ever written out. Variables left with nothing but
one new element join its pivot as a supernode. Priorities are approximate degrees (minimum
degree), those under constraint classes, or fixed positions (analysis of a given order).

Published ideas: multiple minimum degree (Liu 1985), quotient graphs and element absorption
with approximate degrees (Amestoy, Davis, Duff 1996; Davis, Gilbert, Larimore, Ng 2004),
parallel independent pivots (Luby 1986).
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.ranges import global_index, running
from ..core.session import cut, release
from . import settle
from .edges import both_ways

SORT_ROWS = 100_000   # a supernode up to this many columns is ranked in one sort, a larger one over range-laid slices
SMALL = 200           # a piece of a dissection with up to this many nodes is not split further
PART_ROWS = 1_000_000   # a connected part with up to this many rows left ends in one task, larger ones in joined rounds


@dataclass(frozen=True)
class Symbolic:
    """``pivots(front, id, k, round)``, ``rest(front, id)`` off-pivot columns of each front,
    ``absorbed(elem, front)``: where each earlier front (elem >= 0) or row r (elem = -1 - r) went."""
    pivots: DataFrame
    rest: DataFrame
    absorbed: DataFrame

    def order(self) -> DataFrame:
        """(id, pos): elimination order, children before parents."""
        return global_index(self.pivots, [F.col("round"), F.col("front"), F.col("k")], "pos").select("id", "pos")

    def fronts(self) -> DataFrame:
        """(front, parent, round, n_pivot, n_rest); parent -1 at roots."""
        p = self.pivots.groupBy("front").agg(F.min("round").alias("round"), F.count("*").alias("n_pivot"))
        r = self.rest.groupBy("front").agg(F.count("*").alias("n_rest"))
        up = self.absorbed.filter("elem >= 0").select(F.col("elem").alias("front"), F.col("front").alias("parent"))
        return p.join(r, "front", "left").join(up, "front", "left").select(
            "front", F.coalesce("parent", F.lit(-1)).alias("parent"), "round", "n_pivot", F.coalesce("n_rest", F.lit(0)).alias("n_rest"))

    def column_counts(self) -> DataFrame:
        """(id, count): entries of each factor column, diagonal included."""
        return self.pivots.join(self.fronts().select("front", "n_pivot", "n_rest"), "front").select(
            "id", (F.col("n_pivot") - F.col("k") + F.col("n_rest")).alias("count"))

    def totals(self) -> DataFrame:
        """One row: lnz and multiply-add work of the factor."""
        return self.column_counts().agg(F.sum("count").alias("lnz"), F.sum(F.col("count") * F.col("count")).alias("work"))

    def pattern(self) -> DataFrame:
        """(j, i): factor pattern below the diagonal, pivot column j reaching row i."""
        inner = self.pivots.select("front", F.col("id").alias("j"), "k").join(
            self.pivots.select("front", F.col("id").alias("i"), F.col("k").alias("l")), "front").filter("l > k").select("j", "i")
        outer = self.pivots.select("front", F.col("id").alias("j")).join(
            self.rest.select("front", F.col("id").alias("i")), "front").select("j", "i")
        return inner.unionAll(outer)

    def etree(self) -> DataFrame:
        """(id, parent) of the elimination tree, -1 at roots."""
        pos = cut(self.order())
        nxt = self.pivots.select("front", (F.col("k") - 1).alias("k"), F.col("id").alias("parent"))
        first = self.rest.join(pos, "id").groupBy("front").agg(F.min_by("id", "pos").alias("above"))
        return self.pivots.join(nxt, ["front", "k"], "left").join(first, "front", "left").select(
            "id", F.coalesce("parent", "above", F.lit(-1)).alias("parent"))

    def row_pattern(self, rows: DataFrame) -> DataFrame:
        """(i, j): columns reached by each asked row (the row's subtree)."""
        return self.pattern().join(rows.select(F.col("id").alias("i")), "i", "left_semi").select("i", "j")


def _inside(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(elem, front): elements of ``old`` whose members all lie in one of ``fresh``, and the least such one.

    A hub lies in many elements of both sides, so these are not joined over every member: an element of one
    member takes the least element that holds it; others are looked up by the member that the fewest new
    elements hold, and only where sizes and bit masks of the members allow it are the members compared.
    """
    masks = [F.bit_or(F.expr(f"if(pmod(xxhash64(id), 256) div 64 = {k}, shiftleft(1L, cast(pmod(xxhash64(id), 64) as int)), 0L)")).alias(f"m{k}")
             for k in range(4)]
    held = fresh.groupBy("id").agg(F.count("*").alias("_held"), F.min("elem").alias("_least"))
    shape = cut(old.join(held, "id", "left").groupBy("elem").agg(
        F.count("*").alias("n"), F.count("_held").alias("_in"), F.min_by("id", F.struct("_held", "id")).alias("id"),
        F.min("_least").alias("front"), *masks).filter("n = _in"))
    wide = fresh.groupBy("elem").agg(F.count("*").alias("_n"), *[m.alias(f"_m{k}") for k, m in enumerate(masks)]).filter("_n > 1")
    fits = (F.col("_n") >= F.col("n")) & (F.expr(" | ".join(f"(m{k} & ~_m{k})" for k in range(4))) == 0)
    pairs = fresh.join(wide, "elem").withColumnRenamed("elem", "front").join(
        shape.filter("n > 1").select("elem", "id", "n", "m0", "m1", "m2", "m3"), "id").filter(fits).select("elem", "front", "n")
    whole = pairs.join(old, "elem").join(fresh.select(F.col("elem").alias("front"), "id"), ["front", "id"], "left_semi").groupBy(
        "elem", "front", "n").agg(F.count("*").alias("c")).filter("c = n")
    return shape.filter("n = 1").select("elem", "front").unionAll(whole.groupBy("elem").agg(F.min("front").alias("front")))


def _covered(var: DataFrame, fresh: DataFrame) -> DataFrame:
    """(a, b): edges of ``var`` with both ends in one element of ``fresh``, looked up from the end in fewer of them.

    Elements of one member cover no edge; a hub may lie in very many of them.
    """
    wide = fresh.join(fresh.groupBy("elem").agg(F.count("*").alias("_n")).filter("_n > 1").select("elem"), "elem", "left_semi")
    held = wide.groupBy("id").agg(F.count("*").alias("n"))
    ends = var.join(held.select(F.col("id").alias("a"), F.col("n").alias("_a")), "a").join(
        held.select(F.col("id").alias("b"), F.col("n").alias("_b")), "b")
    near = ends.select("a", "b", F.when(F.col("_a") <= F.col("_b"), F.col("a")).otherwise(F.col("b")).alias("id"),
                       F.when(F.col("_a") <= F.col("_b"), F.col("b")).otherwise(F.col("a")).alias("far"))
    return near.join(wide, "id").join(wide.select("elem", F.col("id").alias("far")), ["elem", "far"], "left_semi").select("a", "b").distinct()


def _ended(live: DataFrame, var: DataFrame, memb: DataFrame, known: DataFrame, fixed: bool, rnd: int, most: int):
    """Parts that fit in one task taken to their end: (their rows or None, live, var, memb of the others).

    Repeated ids and missing or other than whole-number classes stay in the joined rounds.
    """
    of = lambda name: known.select(F.col("id").alias(name), "comp").distinct()
    none = F.lit(None).cast("bigint")
    plain = live.schema["cls"].dataType.typeName() in ("byte", "short", "integer", "long")
    if not plain or live.isEmpty():
        return None, live, var, memb
    sides = [live.join(of("id"), "id").select("comp", F.lit(settle.LIVE).alias("kind"), F.col("id").alias("a"), none.alias("b"), F.col("cls").cast("bigint").alias("cls"), "pos"),
             var.join(of("a"), "a").select("comp", F.lit(settle.EDGE).alias("kind"), "a", "b", none.alias("cls"), none.alias("pos")),
             memb.join(of("elem"), "elem").select("comp", F.lit(settle.MEMBER).alias("kind"), F.col("elem").alias("a"), F.col("id").alias("b"), none.alias("cls"), none.alias("pos"))]
    every = cut(sides[0].unionAll(sides[1]).unionAll(sides[2]))
    alive = F.col("kind") == settle.LIVE
    size = every.groupBy("comp").agg(F.count("*").alias("n"), F.count_if(alive).alias("l"), F.count_if(alive & F.col("cls").isNotNull() & F.col("pos").isNotNull()).alias("f"))
    twice = every.filter(alive).groupBy("comp", "a").count().filter("count > 1").select("comp").distinct()
    fits = cut(size.filter((F.col("n") <= PART_ROWS) & (F.col("l") > 0) & (F.col("l") == F.col("f"))).join(twice, "comp", "left_anti").select("comp", "n"))
    total = fits.agg(F.sum("n")).first()[0]
    if total is None:
        return None, live, var, memb
    whole = every.count() == total
    took = every if whole else every.join(fits, "comp", "left_semi")
    ended = cut(settle.settle(took, total, fixed, rnd, most - rnd))
    if whole:
        return ended, live.limit(0), var.limit(0), memb.limit(0)
    others = cut(every.join(fits, "comp", "left_anti"))
    return (ended, cut(others.filter(alive).select(F.col("a").alias("id"), F.col("cls").cast(live.schema["cls"].dataType).alias("cls"), "pos")),
            cut(others.filter(F.col("kind") == settle.EDGE).select("a", "b")), cut(others.filter(F.col("kind") == settle.MEMBER).select(F.col("a").alias("elem"), F.col("b").alias("id"))))


def eliminate(variables: DataFrame, var_edges: DataFrame | None = None, rows: DataFrame | None = None,
              fixed: bool = False, max_rounds: int = 100000) -> Symbolic:
    """Run eliminations on variables(id[, cls][, pos]).

    ``var_edges(src, dst)`` symmetric graph; ``rows(row, id)`` matrix rows as first elements
    (the product A'A is never formed). ``cls`` restricts rounds to the lowest class among a
    variable's reach; ``fixed`` uses ``pos`` instead of degrees.
    """
    spark = variables.sparkSession
    cls = F.col("cls") if "cls" in variables.columns else F.lit(0)
    live = cut(variables.select("id", cls.alias("cls"), (F.col("pos") if fixed else F.lit(0)).cast("bigint").alias("pos")).filter("id is not null"))
    empty_e, empty_m = spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "elem bigint, id bigint")
    var = empty_e if var_edges is None else cut(var_edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    memb = empty_m if rows is None else cut(rows.select((-1 - F.col("row")).alias("elem"), "id").filter("elem is not null and id is not null").distinct())
    # each connected part goes by its own least degree, so parts don't wait for each other
    from .traverse import components
    one = var.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(memb.select(F.col("elem").alias("src"), F.col("id").alias("dst")))
    known = components(both_ways(one), live.select("id").unionAll(memb.select(F.col("elem").alias("id")).distinct()))
    parts = known.join(live, "id", "left_semi") if rows is not None else known
    pivots: list[DataFrame] = []
    rests: list[DataFrame] = []
    gone: list[DataFrame] = []
    for rnd in range(max_rounds):
        ended, live, var, memb = _ended(live, var, memb, known, fixed, rnd, max_rounds)
        if ended is not None:
            pivots.append(ended.filter(F.col("kind") == settle.PIVOT).select(F.col("a").alias("front"), F.col("b").alias("id"), "k", "round"))
            rests.append(ended.filter(F.col("kind") == settle.REST).select(F.col("a").alias("front"), F.col("b").alias("id")))
            gone.append(ended.filter(F.col("kind") == settle.GONE).select(F.col("a").alias("elem"), F.col("b").alias("front")))
        if live.limit(1).count() == 0:
            break
        size = memb.groupBy("elem").agg((F.count("*") - 1).alias("s"))
        by_el = memb.join(size, "elem").groupBy("id").agg(F.sum("s").alias("de"))
        by_var = var.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("dv"))
        deg = F.coalesce("de", F.lit(0)) + F.coalesce("dv", F.lit(0))
        key = F.struct("cls", (F.col("pos") if fixed else deg).alias("d"), "id")
        prio = cut(live.join(by_el, "id", "left").join(by_var, "id", "left").select("id", key.alias("key")))
        low_el = memb.join(prio, "id").groupBy("elem").agg(F.min("key").alias("key"))
        low = memb.join(low_el, "elem").select("id", "key").unionAll(
            var.join(prio.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "key")).groupBy("id").agg(F.min("key").alias("low"))
        sel = prio.join(low, "id", "left").filter(F.col("low").isNull() | (F.col("key") <= F.col("low")))
        if not fixed:
            # of the independent candidates only those near the least degree of their part go this round
            sel = cut(sel.select("id", F.col("key.d").alias("d")).join(parts, "id"))
            least = sel.groupBy("comp").agg(F.floor(F.min("d") * 1.2).alias("_least"))
            sel = sel.join(least, "comp").filter("d <= _least")
        sel = cut(sel.select(F.col("id").alias("s")))
        eaten = memb.join(sel.select(F.col("s").alias("id")), "id").select("elem", F.col("id").alias("front"))
        eaten = cut(eaten)
        fresh = var.join(sel.select(F.col("s").alias("a")), "a").select(F.col("a").alias("elem"), F.col("b").alias("id")).unionAll(
            memb.join(eaten, "elem").select(F.col("front").alias("elem"), "id")).filter("elem <> id").distinct()
        fresh = cut(fresh)
        old = memb.join(eaten.select("elem"), "elem", "left_anti")
        # an older element inside a new one says nothing more
        inside = _inside(old, fresh)
        inside = cut(inside)
        old = old.join(inside.select("elem"), "elem", "left_anti")
        gone += [eaten, inside]
        dead = sel.select(F.col("s").alias("a"))
        var = var.join(dead, "a", "left_anti").join(dead.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
        var = cut(var.join(_covered(var, fresh), ["a", "b"], "left_anti").select("a", "b"))
        # supernodes: members tied to this one new element only
        many = old.select("id").unionAll(var.select(F.col("a").alias("id"))).unionAll(
            fresh.groupBy("id").count().filter("count > 1").select("id")).distinct()
        solo = fresh.join(many.withColumn("_m", F.lit(True)), "id", "left").join(live, "id").select(
            "elem", "id", "cls", "pos", F.col("_m").isNull().alias("free"))
        if fixed:
            solo = solo.join(solo.filter("not free").groupBy("elem").agg(F.min("pos").alias("wall")), "elem", "left").withColumn(
                "free", F.col("free") & (F.col("wall").isNull() | (F.col("pos") < F.col("wall"))))
        else:
            solo = solo.join(solo.filter("not free").groupBy("elem").agg(F.min("cls").alias("wall")), "elem", "left").withColumn(
                "free", F.col("free") & (F.col("wall").isNull() | (F.col("cls") <= F.col("wall"))))
        solo = cut(solo)
        head = sel.select(F.col("s").alias("front"), F.col("s").alias("id"), F.lit(0).cast("bigint").alias("k"))
        joins = solo.filter("free").select(F.col("elem").alias("front"), "id", "cls", "pos")
        order = [F.col("cls"), F.col("pos"), F.col("id")]
        if (joins.groupBy("front").count().agg(F.max("count")).first()[0] or 0) <= SORT_ROWS:
            tail = joins.select("front", "id", F.row_number().over(Window.partitionBy("front").orderBy(*order)).cast("bigint").alias("k"))
        else:
            tail = running(joins, ["front"], order, {"k": F.lit(1).cast("bigint")}).select("front", "id", "k")
        piv = cut(head.unionByName(tail).withColumn("round", F.lit(rnd)))
        rest = solo.filter("not free").select(F.col("elem").alias("front"), "id")
        pivots.append(piv)
        rests.append(rest)
        memb = cut(old.select("elem", "id").unionAll(rest.select(F.col("front").alias("elem"), "id")))
        live = cut(live.join(piv.select("id"), "id", "left_anti"))

    def glue(parts: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(p)
        return cut(out)
    return Symbolic(glue(pivots, "front bigint, id bigint, k bigint, round int"), glue(rests, "front bigint, id bigint"),
                    glue(gone, "elem bigint, front bigint"))


# orderings ---------------------------------------------------------------------------------------

def minimum_degree(edges: DataFrame, nodes: DataFrame) -> Symbolic:
    """Order of a symmetric pattern (both halves; A + A' for others)."""
    return eliminate(nodes.select("id"), edges)


def constrained_minimum_degree(edges: DataFrame, nodes: DataFrame) -> Symbolic:
    """As above, nodes(id, cls): lower classes before higher among connected nodes."""
    return eliminate(nodes.select("id", "cls"), edges)


def column_minimum_degree(a: DataFrame, cls: DataFrame | None = None) -> Symbolic:
    """Column order for A'A of (i, j, v) without forming it; cls(id, cls) constrains columns."""
    cols = a.select(F.col("j").alias("id")).distinct()
    if cls is not None:
        cols = cols.join(cls, "id")
    return eliminate(cols, rows=a.select(F.col("i").alias("row"), F.col("j").alias("id")))


def symbolic_of_order(edges: DataFrame, order: DataFrame) -> Symbolic:
    """Analysis of a given order(id, pos): tree, counts, fill, fronts."""
    return eliminate(order.select("id", "pos"), edges, fixed=True)


def dissection_classes(edges: DataFrame, nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, cls, piece): nested dissection; leaf pieces are class 0, separators rise to the root.

    All pieces of a level split at once: each is numbered breadth-first, halved, and the ends
    of its cut edges on the side with fewer of them become its separator. Without ``levels`` pieces
    of more than ``SMALL`` nodes (distinct then) are split for as long as they hold an edge.
    """
    from .traverse import _breadth_order
    piece = nodes.select("id", F.lit(0).alias("piece"))
    seps, leaves = [], []
    if levels is None:
        piece, edges = piece.distinct(), cut(edges.select("src", "dst"))
    for level in itertools.count() if levels is None else range(levels):
        piece = cut(piece)
        a = piece.select(F.col("id").alias("src"), F.col("piece").alias("_a"))
        b = piece.select(F.col("id").alias("dst"), F.col("piece").alias("_b"))
        # what a piece holds was inside one piece of the level before
        outer, edges = edges, cut(edges.select("src", "dst").join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst", F.col("_a").alias("piece")))
        if level or levels is None:
            release(outer)
        inner = edges
        if levels is None:
            large = cut(piece.groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("piece").join(
                inner.filter("src <> dst").select("piece"), "piece", "left_semi"))
            leaves.append(piece.join(large, "piece", "left_anti").select("id", F.lit(0).alias("cls"), "piece"))
            if large.isEmpty():
                break
            piece = cut(piece.join(large, "piece", "left_semi").select("id", "piece"))
            inner = cut(inner.join(large, "piece", "left_semi").select("src", "dst", "piece"))
            release(edges)
            edges = inner
        order = _breadth_order(inner, piece)
        run = running(piece.join(order, "id"), ["piece"], [F.col("pos")], {"upto": F.lit(1).cast("bigint")})
        half = piece.groupBy("piece").agg(F.count("*").alias("n"))
        side = cut(run.join(half, "piece").select("id", "piece", (F.col("upto") * 2 > F.col("n")).cast("int").alias("side")))
        ends = inner.join(side.select(F.col("id").alias("src"), F.col("side").alias("_s")), "src").join(
            side.select(F.col("id").alias("dst"), F.col("side").alias("_t")), "dst").filter("_s <> _t").select(
            "piece", F.col("src").alias("id"), F.col("_s").alias("side")).distinct()
        pick = ends.groupBy("piece", "side").agg(F.count("*").alias("n")).groupBy("piece").agg(F.min_by("side", F.struct("n", "side")).alias("side"))
        sep = cut(ends.join(pick, ["piece", "side"]).select("id", "piece"))
        seps.append(sep)
        piece = side.join(sep.select("id"), "id", "left_anti").select("id", (F.col("piece") * 2 + F.col("side")).alias("piece"))
    if levels is not None:
        leaves.append(piece.select("id", F.lit(0).alias("cls"), "piece"))
    out = leaves[0]
    for part in leaves[1:] + [sep.select("id", F.lit(len(seps) - level).alias("cls"), "piece") for level, sep in enumerate(seps)]:
        out = out.unionAll(part)
    return out


def nested_dissection(edges: DataFrame, nodes: DataFrame, levels: int | None = None) -> Symbolic:
    """Dissection classes down to small pieces, or of so many levels; minimum degree inside them."""
    return constrained_minimum_degree(edges, cut(dissection_classes(edges, nodes, levels)))


def best_order(edges: DataFrame, nodes: DataFrame, levels: int = 2) -> tuple[str, Symbolic, dict[str, int]]:
    """Try minimum degree, then nested dissection; strictly fewer factor entries win."""
    tried, best = {}, None
    for name, make in (("minimum_degree", lambda: minimum_degree(edges, nodes)),
                       ("nested_dissection", lambda: nested_dissection(edges, nodes, levels))):
        s = make()
        tried[name] = s.totals().first()["lnz"] or 0  # one number per method
        if best is None or tried[name] < tried[best[0]]:
            best = (name, s)
    return best[0], best[1], tried


def separator_tree(classes: DataFrame, levels: int) -> DataFrame:
    """(id, node) of dissection classes made with ``levels``: the root separator is node 1, node k splits
    into 2k and 2k + 1, so the ancestors of a node are its halves."""
    return classes.select("id", F.expr(f"shiftleft(1L, {levels} - cls) + piece").alias("node"))


def _ancestors(node: str) -> Column:
    return F.expr(f"transform(sequence(0, cast(length(bin({node})) as int) - 1), d -> shiftright({node}, d))")


def separator_sizes(member: DataFrame) -> DataFrame:
    """(node, n, total) of member(id, node): own members and those of the whole subtree, nodes without
    members of their own included if something hangs below them."""
    own = member.groupBy("node").agg(F.count("*").alias("n"))
    up = own.select(F.explode(_ancestors("node")).alias("node"), F.col("n").alias("m"))
    return up.groupBy("node").agg(F.sum("m").alias("total")).join(own, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), "total")


def collapse_separators(member: DataFrame, oksep: float, small: int) -> DataFrame:
    """member(id, node) with subtrees of less than ``small`` (at least 4) members, or whose separator holds
    ``oksep`` of the members or more, drawn together at their topmost such node."""
    sizes = cut(separator_sizes(member))
    whole = sizes.filter((F.col("total") < max(4, small)) | (F.col("n") >= min(1.0, max(0.0, oksep)) * F.col("total"))).select(F.col("node").alias("above"))
    top = sizes.select("node", F.explode(_ancestors("node")).alias("above")).join(whole, "above").groupBy("node").agg(F.min("above").alias("top"))
    return member.join(top, "node", "left").select("id", F.coalesce("top", "node").alias("node"))


# trees --------------------------------------------------------------------------------------------

def postorder(parents: DataFrame) -> DataFrame:
    """(id, post) of a forest (id, parent), children by id: subtree sizes upwards, then first
    positions downwards, one join per tree level."""
    tree = cut(parents.select("id", "parent"))
    depth = cut(tree.filter("parent = -1").select("id", F.lit(0).alias("depth")))
    front, d = depth, 0
    while True:
        d += 1
        front = cut(tree.join(front.select(F.col("id").alias("parent")), "parent").select("id", F.lit(d).alias("depth")))
        if front.limit(1).count() == 0:
            break
        depth = depth.unionAll(front)
    depth = cut(depth)
    t = cut(tree.join(depth, "id"))
    size = t.filter(F.col("depth") == d - 1).select("id", F.lit(1).cast("bigint").alias("size"))
    sizes = [cut(size)]
    for level in range(d - 2, -1, -1):
        below = sizes[-1].join(tree, "id").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("b"))
        sizes.append(cut(t.filter(F.col("depth") == level).join(below, "id", "left").select("id", (F.coalesce("b", F.lit(0)) + 1).alias("size"))))
    every = sizes[0]
    for s in sizes[1:]:
        every = every.unionAll(s)
    every = cut(t.join(every, "id"))
    left = cut(running(every, ["parent"], [F.col("id")], {"upto": F.col("size")}).select(
        "id", "parent", "size", "depth", (F.col("upto") - F.col("size")).alias("before")))
    start = cut(left.filter("depth = 0").select("id", F.col("before").alias("start")))
    out, cur = start, start
    for level in range(1, d):
        cur = cut(left.filter(F.col("depth") == level).join(cur.select(F.col("id").alias("parent"), F.col("start").alias("p")), "parent").select(
            "id", (F.col("p") + F.col("before")).alias("start")))
        out = out.unionAll(cur)
    return out.join(left.select("id", "size"), "id").select("id", (F.col("start") + F.col("size") - 1).alias("post"))


def reach_up(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): all tree ancestors of the starts, themselves included (pattern of a sparse solve)."""
    seen = cut(starts.select("id").distinct())
    front = seen
    while True:
        front = cut(parents.join(front, "id").filter("parent <> -1").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut(seen.unionAll(front))


def refreshed_pattern(pattern: DataFrame, order: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(j, i): the factor pattern after the matrix lost entries, from that before, under the same order (id, pos).

    ``edges`` is the matrix graph as it is now, both ways; ``changed`` (id) names the columns that lost entries below
    their diagonal (entries may also appear where ``pattern`` has one). Only these columns and their ancestors are
    worked out anew, children before parents: a column holds its own entries and what columns that end in it hand on.
    """
    pos = cut(order.select("id", "pos"))
    at = lambda name, p: pos.select(F.col("id").alias(name), F.col("pos").alias(p))
    old = cut(pattern.join(at("i", "p"), "i").select("j", "i", "p"))
    parents = cut(old.groupBy(F.col("j").alias("id")).agg(F.min_by("i", "p").alias("parent")))
    todo = reach_up(parents, changed)
    lower = cut(edges.select(F.col("src").alias("j"), F.col("dst").alias("i")).join(at("j", "q"), "j").join(at("i", "p"), "i").filter("p > q")
                .join(todo.select(F.col("id").alias("j")), "j", "left_semi").select("j", "i", "p").distinct())

    def handed(cols: DataFrame) -> DataFrame:
        """(j, i, p): what each column leaves to the first column below its diagonal."""
        first = cols.groupBy("j").agg(F.min_by("i", "p").alias("up"))
        return cols.join(first, "j").filter("i <> up").select(F.col("up").alias("j"), "i", "p")

    kept = old.join(todo.select(F.col("id").alias("j")), "j", "left_anti")
    owed = cut(handed(kept).join(todo.select(F.col("id").alias("j")), "j", "left_semi").distinct())
    done = [kept]
    while not todo.isEmpty():
        busy = todo.join(parents, "id").select(F.col("parent").alias("id")).distinct()
        ready = cut(todo.join(busy, "id", "left_anti").select(F.col("id").alias("j")))
        new = cut(lower.unionByName(owed).join(ready, "j", "left_semi").distinct())
        done.append(new)
        todo = cut(todo.join(ready.select(F.col("j").alias("id")), "id", "left_anti"))
        owed = cut(owed.join(ready, "j", "left_anti").unionByName(handed(new)).distinct())
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("j", "i")


def column_singletons(a: DataFrame, tol: float = 0.0, max_rounds: int = 100000) -> DataFrame:
    """(j, i, round): columns with a single live entry above ``tol``, peeled repeatedly; i is the
    row taken with the column, empty columns have none."""
    live = cut(a.filter(F.abs("v") > 0).select("i", "j", "v"))
    empty = a.select("j").distinct().join(live.select("j"), "j", "left_anti").select("j", F.lit(None).cast("bigint").alias("i"), F.lit(0).alias("round"))
    out = empty
    for rnd in range(max_rounds):
        one = live.groupBy("j").agg(F.count("*").alias("n"), F.min("i").alias("i"), F.max(F.abs("v")).alias("m")).filter(
            (F.col("n") == 1) & (F.col("m") > tol))
        take = cut(one.groupBy("i").agg(F.min("j").alias("j")))
        if take.limit(1).count() == 0:
            return out
        out = out.unionAll(take.select("j", "i", F.lit(rnd).alias("round")))
        live = cut(live.join(take.select("i"), "i", "left_anti"))
    return out
