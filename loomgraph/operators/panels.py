"""QR and Cholesky of fronts as tables of blocks, with the reflectors kept.

A front's columns are cut into panels and its rows into row blocks; a block is one row of a table, with as many
neighbouring panels as one task holds. A step eliminates the panels of one block column: row blocks are reduced on their own, then a tree of small stacks joins
their triangles (tall-skinny QR; Demmel, Grigori, Hoemmen, Langou 2012), and each reduction is a join
with the blocks of the panels to the right. No task holds more than one stack of row blocks of a
panel. All fronts of a tree level run through the same joins, so narrow fronts ride along.

The reflectors of each reduction stay as rows (compact WY form, Schreiber and Van Loan 1989), and so
do the places of rows, so Q and its transpose can be applied to any right-hand side later, up and
down the front tree. Triangular solves, plain and transposed, go by panels in the order of the tree.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.ranges import rank_in_group
from ..core.session import cut, release
from .edges import both_ways
from .elimination import Symbolic

BLOCK = "kind string, front bigint, rb bigint, panel int, n int, w int, m binary"
NODE = ("front bigint, node bigint, members array<struct<rb: bigint, b: int, n: int, gone: int>>, v binary, t binary, "
        "done int, live array<int>, sign binary, last boolean")
ENTRY = "front bigint, rb bigint, panel int, r int, at int, v double"


@dataclass(frozen=True)
class Sizes:
    """Columns in a panel, rows in a block, stacks joined at once; numbers that the matrix of a stack may have."""
    panel: int = 64
    rows: int = 256
    fan: int = 8
    held: int = 2_000_000

    @property
    def width(self) -> int:
        """Columns that a step takes: whole panels, as many as a stack holds."""
        return self.panel * max(1, self.held // (self.fan * self.rows * self.panel))


# kernels on one stack ------------------------------------------------------------------------------

INNER = 32   # columns whose reflectors are made one by one


def reflect(f: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(V, T, live): reflectors that bring ``f`` to echelon form, and the columns that got one; a column whose
    remaining norm is at most ``tol`` gets none."""
    if f.shape[1] <= INNER:
        return _reflect(f, tol)
    f, live = f.copy(), []
    v, t = np.zeros((len(f), 0)), np.zeros((0, 0))
    for a in range(0, f.shape[1], INNER):
        done = len(live)
        low, t2, more = _reflect(f[done:, a:a + INNER], tol)
        f[done:, a:] = turned(low, t2, f[done:, a:], True)
        v2 = np.vstack([np.zeros((done, len(more))), low])
        t = np.block([[t, -t @ (v.T @ v2) @ t2], [np.zeros((len(more), done)), t2]])
        v = np.hstack([v, v2])
        live += [a + k for k in more]
    return v, t, live


def _reflect(f: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    f, vs, taus, live = f.copy(), [], [], []
    for k in range(f.shape[1]):
        done = len(live)
        x = f[done:, k]
        size = np.linalg.norm(x)
        if size <= tol or not len(x):
            continue
        v = np.zeros(len(f))
        v[done:] = x
        v[done] += size if x[0] >= 0 else -size
        tau = 2.0 / (v @ v)
        f[done:, k:] -= tau * np.outer(v[done:], v[done:] @ f[done:, k:])
        vs.append(v)
        taus.append(tau)
        live.append(k)
    v = np.array(vs).T.reshape(len(f), len(live))
    t = np.zeros((len(live), len(live)))
    for j, tau in enumerate(taus):
        t[j, j] = tau
        t[:j, j] = -tau * t[:j, :j] @ (v[:, :j].T @ v[:, j])
    return v, t, live


def turned(v: np.ndarray, t: np.ndarray, c: np.ndarray, transposed: bool) -> np.ndarray:
    """Q' C or Q C for Q = I - V T V'."""
    return c - v @ ((t.T if transposed else t) @ (v.T @ c))


def _bytes(m: np.ndarray) -> bytes:
    """A marker, then the numbers, packed if many of them are zero."""
    raw = np.ascontiguousarray(m, "float64")
    return b"z" + zlib.compress(raw, 1) if np.count_nonzero(raw) < 0.7 * raw.size else b"-" + raw.tobytes()


def _matrix(raw: bytes, width: int) -> np.ndarray:
    held = np.frombuffer(zlib.decompress(memoryview(raw)[1:])) if raw[:1] == b"z" else np.frombuffer(raw, offset=1)
    return held.reshape(len(held) // width if width else 0, width).copy()


def _top(m: np.ndarray) -> int:
    rows = np.flatnonzero(m.any(axis=1))
    return int(rows[-1]) + 1 if len(rows) else 0


# tables of blocks ----------------------------------------------------------------------------------

def dense_blocks(entries: DataFrame) -> DataFrame:
    """Blocks from (front, rb, panel, n, w, r, at, v); places without entries hold zeros, blocks without any are absent."""
    def close(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((key[3], key[4]))
        np.add.at(m, (pdf["r"].to_numpy(), pdf["at"].to_numpy()), pdf["v"].to_numpy())
        return pd.DataFrame([("x", *key, _bytes(m))], columns=["kind", "front", "rb", "panel", "n", "w", "m"])

    return entries.groupBy("front", "rb", "panel", "n", "w").applyInPandas(close, BLOCK)


def entries_of(blocks: DataFrame) -> DataFrame:
    """(front, rb, panel, r, at, v) of the non-zero places."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for x in pdf.itertuples():
                m = _matrix(x.m, x.w)
                r, at = np.nonzero(m)
                yield pd.DataFrame({"front": x.front, "rb": x.rb, "panel": x.panel, "r": r.astype("int32"), "at": at.astype("int32"), "v": m[r, at]})

    return blocks.select("front", "rb", "panel", "w", "m").mapInPandas(run, ENTRY)


def reductions(blocks: DataFrame, step: int, level: int, last: bool, tol: float, fan: int) -> DataFrame:
    """One node for each stack of the step's panel: row blocks themselves at level 0, then ``fan`` of the level below."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for x in pdf.itertuples():
                own = sorted(((s["rb"], s["n"], _matrix(s["m"], x.w)) for s in x.parts), key=lambda s: s[0])
                tops = [len(m) if level == 0 else _top(m) for _, _, m in own]
                f = np.vstack([m[:b] for (_, _, m), b in zip(own, tops)])
                v, t, live = reflect(f, tol if last else 0.0)
                r = turned(v, t, f, True)
                sign = np.array([-1.0 if r[k, c] < 0 else 1.0 for k, c in enumerate(live)])
                before = np.cumsum([0, *tops])   # the finished rows are the first of the stack, whosever they are
                members = [{"rb": rb, "b": b, "n": n, "gone": max(0, min(b, len(live) - at)) if last else 0}
                           for (rb, n, _), b, at in zip(own, tops, before.tolist())]
                out.append((x.front, x.node, members, _bytes(v), _bytes(t), len(live), live, sign.tobytes(), last))
            yield pd.DataFrame(out, columns=["front", "node", "members", "v", "t", "done", "live", "sign", "last"])

    stacks = (blocks.filter(F.col("panel") == step).withColumn("node", F.floor(F.col("rb") / fan ** level))
              .groupBy("front", "node").agg(F.first("w").alias("w"), F.collect_list(F.struct("rb", "n", "m")).alias("parts")))
    if level and not last:
        stacks = stacks.filter(F.size("parts") > 1)
    return stacks.mapInPandas(run, NODE)


def update(blocks: DataFrame, nodes: DataFrame, step: int, under: int, transposed: bool = True, own: bool = False) -> DataFrame:
    """Blocks after one level of reductions, each over ``under`` row blocks; blocks and reductions are dealt once, by stack. At the last level the finished rows come out as kind 'r' (``transposed``),
    or come back from kind 'r' (else). ``own``: the blocks are the front's, and those of the step's panel end here."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for x in pdf.itertuples():
                inside = set() if x.members is None else {s["rb"] for s in x.members}
                out += [(s["kind"], x.front, s["rb"], x.panel, s["n"], x.w, s["m"]) for s in x.parts if s["rb"] not in inside]
                if not any(s["rb"] in inside for s in x.parts):
                    continue
                have = {s["rb"]: _matrix(s["m"], x.w) for s in x.parts if s["kind"] == "x" and s["rb"] in inside}
                members, done = x.members, int(x.done)
                back = next((_matrix(s["m"], x.w) for s in x.parts if s["kind"] == "r" and s["rb"] in inside), np.zeros((done, x.w)))
                first = members[0]["rb"]
                sign = np.frombuffer(x.sign)[:, None]
                at = 0
                for s in members:
                    have.setdefault(s["rb"], np.zeros((s["n"] - (0 if transposed else s["gone"]), x.w)))
                    if not transposed:
                        have[s["rb"]] = np.vstack([(back * sign)[at:at + s["gone"]], have[s["rb"]]])
                        at += s["gone"]
                v = _matrix(x.v, done) if done else np.zeros((sum(s["b"] for s in members), 0))
                t = _matrix(x.t, done)
                c = turned(v, t, np.vstack([have[s["rb"]][:s["b"]] for s in members]), transposed)
                if own and x.panel == step:   # exactly the echelon form
                    c[done:] = 0.0
                    for r, lead in enumerate(x.live):
                        c[r, :lead] = 0.0
                at = 0
                for s in members:
                    have[s["rb"]][:s["b"]] = c[at:at + s["b"]]
                    at += s["b"]
                if x.last and transposed:
                    out.append(("r", x.front, first, x.panel, done, x.w, _bytes(c[:done] * sign)))
                for s in members:
                    m = have[s["rb"]][s["gone"] if transposed else 0:]
                    if not (own and x.last and x.panel == step) and m.any():
                        out.append(("x", x.front, s["rb"], x.panel, len(m), x.w, _bytes(m)))
            yield pd.DataFrame(out, columns=["kind", "front", "rb", "panel", "n", "w", "m"])

    stacks = (blocks.withColumn("node", F.floor(F.col("rb") / under)).repartition("front", "node").groupBy("front", "node", "panel")
              .agg(F.first("w").alias("w"), F.collect_list(F.struct("kind", "rb", "n", "m")).alias("parts")))
    return stacks.join(nodes, ["front", "node"], "left").mapInPandas(run, BLOCK)


@dataclass
class Level:
    """All fronts of a tree level: ``cols(front, col, panel, at, w, pivot)``, ``place(front, row, rb, r, n)``, the
    reductions by step and level of the stack tree, ``ups(front, step, r, row)``: rows that went to the parents."""
    cols: DataFrame
    place: DataFrame
    nodes: list[list[DataFrame]] = field(default_factory=list)
    ups: DataFrame | None = None


def lay_columns(plan: DataFrame, entries: DataFrame, sizes: Sizes) -> DataFrame:
    """Panels of each front: its pivots by k, then its other columns; panels don't mix the two."""
    piv = plan.select("front", F.col("id").alias("col"), "k")
    rest = entries.select("front", "col").distinct().join(piv, ["front", "col"], "left_anti")
    other = rank_in_group(rest, ["front"], [F.col("col")], "k")
    count = lambda df, name: df.groupBy("front").agg(F.count("*").alias(name))
    p = F.lit(sizes.width)
    width = lambda total: F.least(p, F.col(total) - F.floor(F.col("k") / p) * p).cast("int").alias("w")
    first = F.ceil(F.coalesce("np", F.lit(0)) / p)
    a = piv.join(count(piv, "np"), "front").select("front", "col", F.floor(F.col("k") / p).cast("int").alias("panel"), (F.col("k") % p).cast("int").alias("at"), width("np"), F.lit(True).alias("pivot"))
    b = other.join(count(other, "no"), "front").join(count(piv, "np"), "front", "left").select(
        "front", "col", (first + F.floor(F.col("k") / p)).cast("int").alias("panel"), (F.col("k") % p).cast("int").alias("at"), width("no"), F.lit(False).alias("pivot"))
    return cut(a.unionAll(b))


def lay_rows(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """(front, row, rb, r, n) for distinct (front, row)."""
    total = rows.groupBy("front").agg(F.count("*").alias("total"))
    ranked = rank_in_group(rows, ["front"], [F.col("row")], "k").join(total, "front")
    rb = F.floor(F.col("k") / sizes.rows)
    return cut(ranked.select("front", "row", rb.alias("rb"), (F.col("k") % sizes.rows).cast("int").alias("r"),
                             F.least(F.lit(sizes.rows), F.col("total") - rb * sizes.rows).cast("int").alias("n")))


def factor_level(entries: DataFrame, plan: DataFrame, tol: float, sizes: Sizes, rows: DataFrame | None = None) -> tuple[Level, DataFrame, DataFrame]:
    """Level, R rows of its pivots (front, row_id, col, v), and what goes up (front, row, col, v) under the front it
    comes from. ``entries`` (front, row, col, v), ``plan`` (front, id, k); ``rows`` adds rows without entries."""
    entries = cut(entries)
    level = Level(lay_columns(plan, entries, sizes), lay_rows(entries.select("front", "row").distinct() if rows is None else rows, sizes))
    laid = blocks = cut(dense_blocks(entries.join(level.place, ["front", "row"]).join(level.cols.select("front", "col", "panel", "at", "w"), ["front", "col"])))
    most = level.cols.agg(F.max("panel")).first()[0]
    top = level.place.agg(F.max("rb")).first()[0]
    depth = 0
    while top is not None and sizes.fan ** depth <= top:
        depth += 1
    finished = []
    for step in range(0 if most is None or top is None else most + 1):
        made = []
        for t in range(depth + 1):
            nodes = cut(reductions(blocks, step, t, t == depth, tol, sizes.fan))
            before, laid = laid, cut(update(blocks, nodes, step, sizes.fan ** t, own=True))
            release(before)
            blocks = laid
            made.append(nodes)
        finished.append(cut(blocks.filter("kind = 'r'")).withColumn("step", F.lit(step)))
        blocks = blocks.filter("kind = 'x'")
        level.nodes.append(made)
    spark = entries.sparkSession
    if not finished:
        level.ups = spark.createDataFrame([], "front bigint, step int, r int, row bigint")
        return level, spark.createDataFrame([], "front bigint, row_id bigint, col bigint, v double"), entries.filter("false")
    out = []
    for step, (made, rows_of) in enumerate(zip(level.nodes, finished)):
        lead = made[-1].select("front", F.posexplode("live").alias("r", "at")).withColumn("panel", F.lit(step))
        named = lead.join(level.cols, ["front", "panel", "at"]).select("front", "r", F.col("col").alias("row_id"), "pivot")
        got = entries_of(rows_of).join(level.cols.select("front", "panel", "at", "col"), ["front", "panel", "at"])
        out.append(named.join(got.select("front", "r", "col", "v"), ["front", "r"]).withColumn("step", F.lit(step)))
    every = out[0]
    for o in out[1:]:
        every = every.unionAll(o)
    name = F.xxhash64(F.lit("up"), "front", "step", "r").alias("row")
    every = cut(every.select("*", name))
    level.ups = cut(every.filter("not pivot").select("front", "step", "r", "row").distinct())
    return level, every.filter("pivot").select("front", "row_id", "col", "v"), every.filter("not pivot").select("front", "row", "col", "v")


# factorisation over the front tree ------------------------------------------------------------------

def one_front(columns: DataFrame, order: str = "id") -> Symbolic:
    """All columns (id) in one front, by ``order``: for matrices without sparsity worth a tree."""
    return part_fronts(columns.withColumn("front", F.lit(0).cast("bigint")), order)


def part_fronts(columns: DataFrame, order: str = "id") -> Symbolic:
    """Columns (id, front) in the fronts that they name, none above another: one for each connected part of the matrix."""
    ranked = rank_in_group(columns.select("id", "front", F.col(order).alias("_o")), ["front"], [F.col("_o"), F.col("id")], "k")
    spark = columns.sparkSession
    return Symbolic(cut(ranked.select("front", "id", "k", F.lit(0).alias("round"))),
                    spark.createDataFrame([], "front bigint, id bigint"), spark.createDataFrame([], "elem bigint, front bigint"))


def _parts(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((i, front), (id, front)): rows and columns of (i, j, v) by connected part, numbered by its least column."""
    from .traverse import components
    at = a.filter("i is not null and j is not null").select(F.struct(F.lit(0).alias("side"), F.col("j").alias("n")).alias("src"), F.struct(F.lit(1).alias("side"), F.col("i").alias("n")).alias("dst"))
    ends = both_ways(at)
    comp = cut(components(ends, ends.select(F.col("src").alias("id")).distinct()))
    side = lambda k, name: comp.filter(F.col("id.side") == k).select(F.col("id.n").alias(name), F.col("comp.n").alias("front"))
    return side(1, "i"), side(0, "id")


@dataclass(frozen=True)
class KeptQR:
    """``r(front, row_id, col, v)``: row of each live pivot, ``dead(id)``, ``pivots(id, front, panel, at, round)`` and the
    levels with their reflectors; ``home(i, front, row)``: where each matrix row starts."""
    r: DataFrame
    dead: DataFrame
    pivots: DataFrame
    home: DataFrame
    parent: DataFrame
    levels: list[Level]
    sizes: Sizes


def kept_qr(a: DataFrame, symbolic: Symbolic | None = None, tol: float = 0.0, sizes: Sizes = Sizes()) -> KeptQR:
    """QR of (i, j, v) with everything needed to apply Q. Without ``symbolic`` the columns of each connected part form one
    front in id order.

    Rows of ``a`` without entries don't exist: name a row by a zero entry to have Q act on it.
    """
    a = cut(a)
    if symbolic is None:
        home, columns = _parts(a)
        s = part_fronts(columns)
    else:
        s = symbolic
        home = s.absorbed.filter("elem < 0").select((-1 - F.col("elem")).alias("i"), "front")
    home = cut(home.withColumn("row", F.xxhash64(F.lit("row"), "i")))
    parent = cut(s.fronts().select("front", "parent"))
    pending = cut(a.filter("v <> 0").join(home, "i").select("front", "row", F.col("j").alias("col"), "v"))
    born = home.select("front", "row")
    levels, made, dead, pivots = [], [], [], []
    for rnd in range((s.pivots.agg(F.max("round")).first()[0] or 0) + 1):
        plan = cut(s.pivots.filter(F.col("round") == rnd).select("front", "id", "k"))
        here = plan.select("front").distinct()
        level, r, up = factor_level(pending.join(here, "front", "left_semi"), plan, tol, sizes, born.join(here, "front", "left_semi").distinct())
        levels.append(level)
        made.append(r)
        pivots.append(level.cols.filter("pivot").select(F.col("col").alias("id"), "front", "panel", "at", F.lit(rnd).alias("round")))
        up = up.join(parent.withColumnRenamed("front", "f"), F.col("front") == F.col("f")).select(F.col("parent").alias("front"), "row", "col", "v")
        pending = cut(pending.join(here, "front", "left_anti").unionByName(up))
        rise = level.ups.join(parent, "front").select(F.col("parent").alias("front"), "row")
        born = cut(born.join(here, "front", "left_anti").unionByName(rise))
    glued = lambda parts: cut(_union(parts))
    r, piv = glued(made), glued(pivots)
    return KeptQR(r, cut(piv.select("id").join(r.select(F.col("row_id").alias("id")), "id", "left_anti")), piv, home, parent, levels, sizes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _right_sides(rows: DataFrame, place: DataFrame, sizes: Sizes) -> DataFrame:
    """Blocks of right-hand sides (front, row, c, v); ``c`` counts from 0."""
    p = sizes.panel
    laid = rows.join(place, ["front", "row"]).select("front", "rb", F.floor(F.col("c") / p).cast("int").alias("panel"), "n", F.lit(p).alias("w"), "r", (F.col("c") % p).cast("int").alias("at"), "v")
    return dense_blocks(laid)


def _named(df: DataFrame, sizes: Sizes) -> DataFrame:
    return df.withColumn("c", F.col("panel").cast("bigint") * sizes.panel + F.col("at")).drop("panel", "at")


def apply_qt(qr: KeptQR, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q' Y for (i, c, v): (row_id, c, v) over live pivots, and (round, front, rb, r, c, v), the part outside the range of A."""
    pending = cut(y.join(qr.home, "i").select("front", "row", "c", "v"))
    found, spare = [], []
    for rnd, level in enumerate(qr.levels):
        blocks = cut(_right_sides(pending, level.place, qr.sizes))
        done = []
        for step, made in enumerate(level.nodes):
            for t, nodes in enumerate(made):
                blocks = cut(update(blocks, nodes, step, qr.sizes.fan ** t))
            done.append(_named(entries_of(blocks.filter("kind = 'r'")), qr.sizes).withColumn("step", F.lit(step)))
            blocks = blocks.filter("kind = 'x'")
        spare.append(_named(entries_of(blocks), qr.sizes).withColumn("round", F.lit(rnd)))
        if not done:
            continue
        rows = cut(_union(done))
        lead = _union([m[-1].select("front", F.posexplode("live").alias("r", "at")).withColumn("panel", F.lit(k)) for k, m in enumerate(level.nodes)])
        named = lead.join(level.cols.filter("pivot"), ["front", "panel", "at"]).select("front", F.col("panel").alias("step"), "r", F.col("col").alias("row_id"))
        found.append(rows.join(named, ["front", "step", "r"]).select("row_id", "c", "v"))
        up = rows.join(level.ups, ["front", "step", "r"]).join(qr.parent, "front").select(F.col("parent").alias("front"), "row", "c", "v")
        pending = cut(pending.join(level.place.select("front", "row"), ["front", "row"], "left_anti").unionByName(up))
    return cut(_union(found)), cut(_union(spare).select("round", "front", "rb", "r", "c", "v"))


def apply_q(qr: KeptQR, z: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """Q Z as (i, c, v) for Z over live pivots (row_id, c, v), plus the part outside the range as ``apply_qt`` returns it."""
    p = qr.sizes.panel
    z = cut(z)
    came = None   # (front, step, r, c, v): rows that came down for 'other' panels
    out = []
    for rnd in range(len(qr.levels) - 1, -1, -1):
        level = qr.levels[rnd]
        lead = _union([m[-1].select("front", F.posexplode("live").alias("r", "at")).withColumn("panel", F.lit(k)) for k, m in enumerate(level.nodes)]) if level.nodes else None
        if lead is None:
            continue
        named = lead.join(level.cols.filter("pivot"), ["front", "panel", "at"]).select("front", F.col("panel").alias("step"), "r", F.col("col").alias("row_id"))
        back = z.join(named, "row_id").select("front", "step", "r", "c", "v")
        if came is not None:
            back = back.unionByName(came.join(level.ups, "row").select("front", "step", "r", "c", "v"))
        back = cut(back)
        size = level.place.select("front", "rb", "n").distinct()
        roots = _union([m[-1].select("front", F.lit(k).alias("step"), F.col("members")[0]["rb"].alias("rb"), "done") for k, m in enumerate(level.nodes)])
        cols = [F.floor(F.col("c") / p).cast("int").alias("panel"), F.lit(p).alias("w"), (F.col("c") % p).cast("int").alias("at")]
        if rest is None:
            blocks = None
        else:   # rows left in a row block after all steps
            taken = _union([m[-1].select("front", F.explode("members").alias("x")).select("front", "x.rb", "x.gone") for m in level.nodes])
            left = size.join(taken.groupBy("front", "rb").agg(F.sum("gone").alias("gone")), ["front", "rb"], "left").select("front", "rb", (F.col("n") - F.coalesce("gone", F.lit(0))).cast("int").alias("n"))
            blocks = dense_blocks(rest.filter(F.col("round") == rnd).join(left, ["front", "rb"]).select("front", "rb", "n", "r", "v", *cols))
        for step in range(len(level.nodes) - 1, -1, -1):
            own = back.filter(F.col("step") == step).join(roots.filter(F.col("step") == step).select("front", "rb", F.col("done").alias("n")), "front").select("front", "rb", "n", "r", "v", *cols)
            new = dense_blocks(own).withColumn("kind", F.lit("r"))
            blocks = cut(new if blocks is None else blocks.unionByName(new))
            for t, nodes in reversed([*enumerate(level.nodes[step])]):
                blocks = cut(update(blocks, nodes, step, qr.sizes.fan ** t, transposed=False))
        rows = cut(_named(entries_of(blocks), qr.sizes).join(level.place, ["front", "rb", "r"]).select("front", "row", "c", "v"))
        out.append(rows.join(qr.home, ["front", "row"]).select("i", "c", "v"))
        down = rows.join(qr.home, ["front", "row"], "left_anti").select("row", "c", "v")
        came = cut(down if came is None else came.unionByName(down))
    return cut(_union(out))


# triangular solves by panels ------------------------------------------------------------------------

def _triangle(transposed: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["c"] < 0]
        size = int(max(own["p"].max(), own["q"].max())) + 1
        t = np.zeros((size, size))
        t[own["p"], own["q"]] = own["v"]
        live = np.flatnonzero(np.diag(t))
        right = pdf[pdf["c"] >= 0]
        sides = np.unique(right["c"])
        b = np.zeros((size, len(sides)))
        np.add.at(b, (right["p"], np.searchsorted(sides, right["c"])), right["v"])
        t = t[np.ix_(live, live)]
        x = np.linalg.solve(t.T if transposed else t, b[live])
        k, c = np.nonzero(np.ones_like(x, bool))
        return pd.DataFrame({"front": int(pdf["front"].iloc[0]), "panel": int(pdf["panel"].iloc[0]), "at": live[k], "c": sides[c], "v": x[k, c]})
    return run


def solve_r(qr: KeptQR, b: DataFrame, transposed: bool = False) -> DataFrame:
    """(id, c, v) with R X = B, or R' X = B, over live pivots; B is (id, c, v), missing entries are zero. One round of
    joins for each panel of each tree level, from the roots down, or from the leaves up."""
    own = qr.pivots.join(qr.dead, "id", "left_anti")
    row = own.select(F.col("id").alias("row_id"), "panel", F.col("at").alias("p"), "round")
    col = own.select(F.col("id").alias("col"), F.col("front").alias("cf"), F.col("panel").alias("cp"), F.col("at").alias("q"), F.col("round").alias("cr"))
    r = cut(qr.r.join(row, "row_id").join(col, "col").withColumn("inner", (F.col("front") == F.col("cf")) & (F.col("panel") == F.col("cp"))))
    stages = sorted(tuple(s) for s in own.select("round", "panel").distinct().collect())   # one for each panel of a tree level
    owed = cut(b.join(own, "id").select("id", "front", "panel", "at", "round", "c", "v"))
    out = []
    for rnd, panel in (stages if transposed else reversed(stages)):
        now = (F.col("round") == rnd) & (F.col("panel") == panel)
        tri = r.filter(now & F.col("inner")).select("front", "panel", "p", "q", F.lit(-1).cast("bigint").alias("c"), "v")
        side = owed.filter(now).select("front", "panel", F.col("at").alias("p"), F.lit(0).alias("q"), "c", "v")
        todo = tri.join(side.select("front").distinct(), "front", "left_semi").unionByName(side)
        got = todo.groupBy("front", "panel").applyInPandas(_triangle(transposed), "front bigint, panel int, at int, c bigint, v double")
        got = cut(got.join(own.select("id", "front", "panel", "at"), ["front", "panel", "at"]).select("id", "c", "v"))
        out.append(got)
        if transposed:   # what this panel's rows owe to the columns on their right
            hit = r.filter(now & ~F.col("inner")).join(got.select(F.col("id").alias("row_id"), "c", F.col("v").alias("x")), "row_id").select(
                F.col("col").alias("id"), F.col("cf").alias("front"), F.col("cp").alias("panel"), F.col("q").alias("at"), F.col("cr").alias("round"), "c", (-F.col("v") * F.col("x")).alias("v"))
        else:            # what rows above or below in the tree hold in this panel's columns
            hit = r.filter((F.col("cr") == rnd) & (F.col("cp") == panel) & ~F.col("inner")).join(got.select(F.col("id").alias("col"), "c", F.col("v").alias("x")), "col").select(
                F.col("row_id").alias("id"), "front", "panel", F.col("p").alias("at"), "round", "c", (-F.col("v") * F.col("x")).alias("v"))
        owed = cut(owed.filter(~now).unionByName(hit).groupBy("id", "front", "panel", "at", "round", "c").agg(F.sum("v").alias("v")))
    return cut(_union(out)) if out else b.select("id", "c", "v").filter("false")


def least_squares(qr: KeptQR, b: DataFrame) -> DataFrame:
    """(id, c, v) minimising |A X - B| for (i, c, v), dead columns at zero: Q' B, then R."""
    got, _ = apply_qt(qr, b)
    return solve_r(qr, got.withColumnRenamed("row_id", "id"))


def least_norm(qr_of_transpose: KeptQR, b: DataFrame) -> DataFrame:
    """(i, c, v): the shortest X with A X = B, from the QR of A' whose columns are the rows of A: R' first, then Q."""
    return apply_q(qr_of_transpose, solve_r(qr_of_transpose, b, transposed=True).withColumnRenamed("id", "row_id"))


# other forms ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class KeptLQ:
    """A = L Q: ``l(i, k, v)`` with a column for each live row k of A, lower trapezoidal along the rows' order; Q acts
    through the QR of A'."""
    l: DataFrame
    qr: KeptQR

    def apply_q(self, y: DataFrame) -> DataFrame:
        """(row_id, c, v) = Q Y for (i, c, v) over the columns of A."""
        return apply_qt(self.qr, y)[0]

    def apply_qt(self, z: DataFrame) -> DataFrame:
        """(i, c, v) = Q' Z over the columns of A."""
        return apply_q(self.qr, z)


def kept_lq(a: DataFrame, tol: float = 0.0, sizes: Sizes = Sizes()) -> KeptLQ:
    qr = kept_qr(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), tol=tol, sizes=sizes)
    return KeptLQ(qr.r.select(F.col("col").alias("i"), F.col("row_id").alias("k"), "v"), qr)


def trapezoidal(qr: KeptQR) -> tuple[DataFrame, DataFrame]:
    """R with its dead columns moved behind the live ones: (row_pos, col_pos, v), whose leading square is upper
    triangular with a full diagonal, and the permutation (col, pos, live)."""
    order = [F.col("late"), F.col("round"), F.col("front"), F.col("panel"), F.col("at")]
    late = qr.pivots.join(qr.dead.withColumn("late", F.lit(True)), "id", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    perm = cut(rank_in_group(late.withColumn("g", F.lit(0)), ["g"], order, "pos").select(F.col("id").alias("col"), "pos", (~F.col("late")).alias("live")))
    t = qr.r.join(perm.select("col", F.col("pos").alias("col_pos")), "col").join(perm.select(F.col("col").alias("row_id"), F.col("pos").alias("row_pos")), "row_id")
    return t.select("row_pos", "col_pos", "v"), perm


# Cholesky of wide fronts ----------------------------------------------------------------------------

def block_cholesky(entries: DataFrame, plan: DataFrame, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """Partial Cholesky of fronts as tables of square blocks: (front, i, j, v) of the factor's pivot columns, and of
    the update that goes to the parents. ``entries`` (front, i, j, v), one half; ``plan`` (front, id, k), k < 0 off the pivots.

    A step factors the diagonal block of a pivot panel, solves the blocks below it, and subtracts their products
    from the blocks to the right: each a join by block, so a task holds three blocks at most.
    """
    p = sizes.panel
    piv = plan.filter("k >= 0").select("front", "id", "k")
    rest = rank_in_group(plan.filter("k < 0").select("front", "id"), ["front"], [F.col("id")], "k")
    first = piv.groupBy("front").agg(F.ceil(F.count("*") / p).cast("int").alias("first"), F.count("*").alias("np"))
    cols = piv.join(first, "front").select("front", "id", F.floor(F.col("k") / p).cast("int").alias("b"), (F.col("k") % p).cast("int").alias("at"), F.lit(True).alias("pivot")).unionAll(
        rest.join(first, "front").select("front", "id", (F.col("first") + F.floor(F.col("k") / p)).cast("int").alias("b"), (F.col("k") % p).cast("int").alias("at"), F.lit(False).alias("pivot")))
    width = cols.groupBy("front", "b").agg(F.count("*").cast("int").alias("w"))
    cols = cut(cols.join(width, ["front", "b"]))
    side = lambda name, x: cols.select("front", F.col("id").alias(name), F.struct("b", "at", "w").alias(x))
    both = entries.join(side("i", "x"), ["front", "i"]).join(side("j", "y"), ["front", "j"])
    low = F.when(F.struct("x.b", "x.at") >= F.struct("y.b", "y.at"), F.struct(F.col("x").alias("r"), F.col("y").alias("c"))).otherwise(F.struct(F.col("y").alias("r"), F.col("x").alias("c")))
    laid = both.withColumn("l", low).select("front", F.col("l.r.b").cast("bigint").alias("rb"), F.col("l.c.b").alias("panel"), F.col("l.r.w").alias("n"), F.col("l.c.w").alias("w"),
                                            F.col("l.r.at").alias("r"), F.col("l.c.at").alias("at"), "v")
    blocks = cut(dense_blocks(laid).drop("kind"))
    most = first.agg(F.max("first")).first()[0] or 0
    pivots = first.select("front", "first")
    done = []

    def factored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(x.front, x.rb, x.panel, x.n, x.w, _bytes(np.linalg.cholesky((lambda m: np.tril(m) + np.tril(m, -1).T)(_matrix(x.m, x.w))))) for x in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["front", "rb", "panel", "n", "w", "m"])

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(x.front, x.rb, x.panel, x.n, x.w, _bytes(np.linalg.solve(_matrix(x.d, x.w), _matrix(x.m, x.w).T).T)) for x in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["front", "rb", "panel", "n", "w", "m"])

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(x.front, x.rb, x.panel, x.n, x.w, (_matrix(x.o, x.w) if x.o is not None else np.zeros((x.n, x.w))
                                                       ) - (_matrix(x.a, x.k) @ _matrix(x.b, x.k).T if x.a is not None else 0.0)) for x in pdf.itertuples()]
            yield pd.DataFrame([(*o[:5], _bytes(o[5])) for o in out], columns=["front", "rb", "panel", "n", "w", "m"])

    shape = "front bigint, rb bigint, panel int, n int, w int, m binary"
    for step in range(most):
        here = blocks.join(pivots.filter(F.col("first") > step).select("front"), "front", "left_semi")
        diag = cut(here.filter((F.col("panel") == step) & (F.col("rb") == step)).mapInPandas(factored, shape))
        lower = here.filter((F.col("panel") == step) & (F.col("rb") > step)).join(diag.select("front", F.col("m").alias("d")), "front")
        lower = cut(lower.mapInPandas(below, shape))
        done.append(diag.unionByName(lower))
        a = lower.select("front", "rb", "n", F.col("m").alias("a"), F.col("w").alias("k"))
        b = lower.select("front", F.col("rb").cast("int").alias("panel"), F.col("n").alias("w"), F.col("m").alias("b"))
        pairs = a.join(b, "front").filter("rb >= panel")
        left = blocks.join(done[-1].select("front", "rb", "panel"), ["front", "rb", "panel"], "left_anti")
        met = left.select("front", "rb", "panel", F.col("n").alias("n0"), F.col("w").alias("w0"), F.col("m").alias("o")).join(pairs, ["front", "rb", "panel"], "full").select(
            "front", "rb", "panel", F.coalesce("n", "n0").alias("n"), F.coalesce("w", "w0").alias("w"), "o", "a", "b", "k")
        blocks = cut(met.mapInPandas(product, shape))
    names = cols.select("front", F.col("b").alias("panel"), "at", "id", "pivot")
    l = entries_of(_union(done)) if done else None

    def named(df: DataFrame) -> DataFrame:
        return df.join(names.select("front", "panel", "at", F.col("id").alias("j")), ["front", "panel", "at"]).drop("panel", "at").join(
            names.select("front", F.col("panel").cast("bigint").alias("rb"), F.col("at").alias("r"), F.col("id").alias("i")), ["front", "rb", "r"]).select("front", "i", "j", "v")

    half = entries_of(blocks).filter((F.col("rb") > F.col("panel")) | (F.col("r") >= F.col("at")))
    return named(l) if l is not None else entries.filter("false"), named(half)
