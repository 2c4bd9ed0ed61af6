"""Eliminations of connected parts that fit in one task, by the same rounds as ``elimination.eliminate``.

A part is what is left of a connected part of the quotient graph: live variables, edges between variables, and
members of elements. Its rounds depend on nothing outside it, so parts of bounded size run side by side, many to a task.
What happens in a part depends on the order of its ids and positions only, so small parts of one shape are worked out once.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIVE, EDGE, MEMBER = 0, 1, 2            # input kinds: (id, -, cls, pos), (a, b), (elem, id)
PIVOT, REST, GONE = 0, 1, 2             # output kinds: (front, id, k, round), (front, id), (elem, front)
SCHEMA = "kind int, a bigint, b bigint, k bigint, round int"
TASK_ROWS = 200_000                     # rows a task holds, if no single part has more
SHAPE_ROWS, SHAPES = 96, 20_000         # shapes up to this many rows are kept, so many at most


def rounds(live: list[bool], cls: list[int], pos: list[int], edges: list, members: list, elems: int, fixed: bool, most: int) -> list[tuple]:
    """(kind, a, b, k, round) of one part; nodes are 0.., its elements follow them."""
    n, made = len(live), []
    out: list[set] = [set() for _ in live]
    back: list[set] = [set() for _ in live]
    of: list[set] = [set() for _ in live]
    held = {n + e: set() for e in range(elems)}
    for a, b in edges:
        out[a].add(b)
        back[b].add(a)
    for e, i in members:
        held[n + e].add(i)
        of[i].add(n + e)
    left = {i for i in range(n) if live[i]}
    key: dict[int, tuple] = {}
    low: dict[int, tuple] = {}
    hot, dirty, rnd = left, list(held), 0
    while left and rnd < most:
        for i in hot:
            key[i] = (cls[i], pos[i] if fixed else sum(len(held[e]) - 1 for e in of[i]) + len(out[i]), i)
        for e in dirty:
            low[e] = min((key[i] for i in held[e] if i in left), default=())
        sel = sorted(i for i in left if all(low[e] == key[i] for e in of[i]) and all(key[j] >= key[i] for j in out[i] if j in left))
        if not fixed:
            least = math.floor(min(key[i][1] for i in sel) * 1.2)
            sel = [i for i in sel if key[i][1] <= least]
        fresh: dict[int, set] = {}
        for s in sel:
            f = set(out[s])
            for e in list(of[s]):
                made.append((GONE, e, s, 0, rnd))
                f |= held[e]
                for i in held.pop(e):
                    of[i].discard(e)
            f.discard(s)
            if f:
                fresh[s] = f
        by: dict[int, list] = {}
        for s, f in fresh.items():
            for i in f:
                by.setdefault(i, []).append(s)
        # an older element inside a new one says nothing more
        for e in set().union(*(of[i] for i in by)):
            fewest = min((by.get(i, ()) for i in held[e]), key=len)
            inside = next((s for s in fewest if held[e] <= fresh[s]), None)
            if inside is not None:
                made.append((GONE, e, inside, 0, rnd))
                for i in held.pop(e):
                    of[i].discard(e)
        for s in sel:
            for b in out[s]:
                back[b].discard(s)
            for a in back[s]:
                out[a].discard(s)
            out[s], back[s] = set(), set()
        for f in fresh.values():
            for a in f:
                if out[a]:
                    lost = out[a] & f
                    out[a] -= lost
                    for b in lost:
                        back[b].discard(a)
        left.difference_update(sel)
        rests = {}
        wall_of = pos if fixed else cls
        for s in sel:
            made.append((PIVOT, s, s, 0, rnd))
            mine = [i for i in fresh.get(s, ()) if i in left]
            tied = [i for i in mine if of[i] or out[i] or len(by[i]) > 1]
            wall = min((wall_of[i] for i in tied), default=None)
            stay = set(tied) | {i for i in mine if wall is not None and (pos[i] >= wall if fixed else cls[i] > wall)}
            for k, i in enumerate(sorted((i for i in mine if i not in stay), key=lambda i: (cls[i], pos[i], i)), 1):
                made.append((PIVOT, s, i, k, rnd))
                left.discard(i)
            if stay:
                rests[s] = stay
                made += [(REST, s, i, 0, rnd) for i in stay]
        hot = set()
        for s, stay in rests.items():
            held[s] = stay
            hot |= stay
            for i in stay:
                of[i].add(s)
        dirty = set().union(*(of[i] for i in hot))
        rnd += 1
    return made


def _places(c: np.ndarray, x: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]], parts: int):
    """(names, starts, places): distinct ids of each part in order, and the place of every asked (part, id) in its part."""
    every_c = np.concatenate([c, *[m[0] for m in more]])
    names, code = np.unique(np.concatenate([x, *[m[1] for m in more]]), return_inverse=True)
    pair, at = np.unique(every_c * max(1, len(names)) + code, return_inverse=True)
    starts = np.searchsorted(pair, np.arange(parts + 1) * max(1, len(names)))
    at = at - starts[every_c]
    sizes = np.cumsum([len(c), *[len(m[0]) for m in more]])[:-1]
    return names[pair % max(1, len(names))] if len(names) else names, starts, np.split(at, sizes)


def _ranks(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dense ranks inside each part."""
    if not len(x):
        return x
    by = np.lexsort((x, c))
    cs, xs = c[by], x[by]
    first = np.append(True, cs[1:] != cs[:-1])
    step = np.cumsum(np.append(0, (xs[1:] != xs[:-1]) | first[1:]))
    out = np.empty(len(x), "int64")
    out[by] = step - np.maximum.accumulate(np.where(first, step, 0))
    return out


def _sorted_pairs(c: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((b, a, c))
    return np.ascontiguousarray(np.stack([a[by], b[by]], 1)), np.searchsorted(c[by], np.arange(parts + 1))


def _kernel(fixed: bool, start: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        comps, c = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        kind, a, b, parts = pdf["kind"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy(), len(comps)
        v, e, m = kind == LIVE, kind == EDGE, kind == MEMBER
        ids, first, (iv, ia, ib, im) = _places(c[v], a[v], [(c[e], a[e]), (c[e], b[e]), (c[m], b[m])], parts)
        elems, efirst, (em,) = _places(c[m], a[m], [], parts)
        node = np.zeros((len(ids), 3), "int64")
        node[first[c[v]] + iv] = np.stack([np.ones(len(iv), "int64"), pdf["cls"].to_numpy()[v], _ranks(c[v], pdf["pos"].to_numpy()[v])], 1)
        edges, estart = _sorted_pairs(c[e], ia, ib, parts)
        members, mstart = _sorted_pairs(c[m], em, im, parts)
        known: dict[tuple, np.ndarray] = {}
        got = []
        for p in range(parts):
            x, y, z = node[first[p]:first[p + 1]], edges[estart[p]:estart[p + 1]], members[mstart[p]:mstart[p + 1]]
            small = len(x) + len(y) + len(z) <= SHAPE_ROWS
            shape = (x.tobytes(), y.tobytes(), z.tobytes()) if small else None
            rows = known.get(shape) if small else None
            if rows is None:
                made = rounds(x[:, 0].astype(bool).tolist(), x[:, 1].tolist(), x[:, 2].tolist(), y.tolist(), z.tolist(),
                              int(efirst[p + 1] - efirst[p]), fixed, most)
                rows = np.array(made, "int64").reshape(-1, 5)
                if small:
                    if len(known) >= SHAPES:
                        known.clear()
                    known[shape] = rows
            named = rows.copy()
            names = np.concatenate([ids[first[p]:first[p + 1]], elems[efirst[p]:efirst[p + 1]]])
            named[:, 1], named[:, 2] = names[rows[:, 1]], names[rows[:, 2]]
            got.append(named)
        every = np.concatenate(got) if got else np.zeros((0, 5), "int64")
        return pd.DataFrame({"kind": every[:, 0].astype("int32"), "a": every[:, 1], "b": every[:, 2], "k": every[:, 3],
                             "round": (every[:, 4] + start).astype("int32")})
    return run


def settle(rows: DataFrame, total: int, fixed: bool, start: int, most: int) -> DataFrame:
    """(kind, a, b, k, round) for whole parts given as ``rows(comp, kind, a, b, cls, pos)``, ``total`` rows in all."""
    packs = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    pack = F.pmod(F.xxhash64("comp"), F.lit(packs)).alias("pack")
    return rows.select(pack, "comp", "kind", "a", "b", "cls", "pos").repartition(packs, "pack").groupBy("pack").applyInPandas(
        lambda pdf: _kernel(fixed, start, most)(pdf), SCHEMA)
