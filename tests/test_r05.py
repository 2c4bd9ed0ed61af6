"""Regressions of the fifth round: whole iterations and dissections, files that go when they are read, fronts by the stack."""
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.core.session import cut, local_session, release
from loomgraph.operators import elimination as E
from loomgraph.operators import factor, matrix, panels
from loomgraph.operators import transforms as T
from loomgraph.operators.edges import both_ways


@pytest.fixture(scope="module")
def spark():
    return local_session(4)


def table(spark, rows, names="i bigint, j bigint, v double"):
    return spark.createDataFrame(rows, names)


def test_power_iteration_runs_until_it_settles(spark):
    """A path of 12 nodes: neighbouring eigenvalues lie close, a dozen rounds are far off."""
    n = 12
    rows = [(a, a, 2.0) for a in range(n)] + [(a, b, -1.0) for a in range(n) for b in (a - 1, a + 1) if 0 <= b < n]
    want = 2 + 2 * np.cos(np.pi / (n + 1))
    assert abs(T.largest_eigenvalue(table(spark, rows, "src bigint, dst bigint, w double"), spark.range(n)) - want) < 1e-6


def test_dissection_goes_down_to_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(E, "SMALL", 6, raising=False)
    path = [(k, k + 1) for k in range(19)]
    e = both_ways(table(spark, path, "src bigint, dst bigint"))
    got = E.dissection_classes(e, spark.range(20)).collect()
    piece = {r.id: (r.cls, r.piece) for r in got}
    assert len(got) == len(piece) == 20 and max(r.cls for r in got) == 2
    leaves = [p for p in piece.values() if p[0] == 0]
    assert max(leaves.count(p) for p in leaves) <= 6
    assert not [1 for a, b in path if piece[a][0] == piece[b][0] == 0 and piece[a] != piece[b]]


def test_dense_rows_are_runs_between_entries(spark):
    rows = [(0, 0, 1.0), (0, 4, None), (2, 3, 2.5), (2, 1, -1.0), (2, 9, 7.0), (2, -1, 7.0), (5, 1, 1.0), (None, 1, 3.0)]
    out = matrix.to_dense(table(spark, rows), 4, 5)
    want = [[1, 0, 0, 0, 0], [0] * 5, [0, -1, 0, 2.5, 0], [0] * 5]
    assert [r.row for r in out.orderBy("i").collect()] == want
    assert dict(out.dtypes) == {"i": "bigint", "row": "array<double>"}
    assert "element_at" not in out._jdf.queryExecution().optimizedPlan().toString().lower()   # a scan of the row's entries for every column


def test_shuffle_files_go_with_the_cut(spark):
    def shuffles():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in kept.split() if "shuffle_" in f}

    before = shuffles()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = cut(df)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(.2)
    assert not shuffles() - before
    assert kept.count() == 7 and sorted(r.n for r in df.collect()) == [142] + [143] * 6
    release(kept)


def fronts(rnd, kinds=60):
    """Small fronts, some with dead columns, some without rows: {front: (rows x columns, ids, pivots)}."""
    made = {}
    for f in range(kinds):
        p, q, m = rnd.integers(1, 4), rnd.integers(0, 3), rnd.integers(0, 7)
        a = rnd.standard_normal((m, p + q))
        if p > 1 and f % 3 == 0:
            a[:, 1] = a[:, 0]
        made[f] = a, rnd.permutation(50)[:p + q], p
    return made


@pytest.mark.parametrize("alone", [1 << 12, 4])
def test_fronts_of_a_task_share_householder_steps(monkeypatch, alone):
    monkeypatch.setattr(factor, "ALONE", alone, raising=False)
    made, steps, norm = fronts(np.random.default_rng(1)), [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda *a, **k: steps.append(1) or norm(*a, **k))
    plan = pd.DataFrame([(f, 100 + f, ids[k], k) for f, (_, ids, p) in made.items() for k in range(p)], columns=["front", "parent", "id", "k"])
    rows = pd.DataFrame([(f, 7 * r - 20, ids[c], a[r, c]) for f, (a, ids, _) in made.items() for r in range(len(a)) for c in range(len(ids))],
                        columns=["front", "row", "col", "v"])
    got = factor._front_qr(1e-9)(rows.sample(frac=1, random_state=1), plan.sample(frac=1, random_state=2))
    assert alone == 4 or len(steps) < len(plan)
    for f, (a, ids, p) in made.items():
        own, up = got[(got.kind == "r") & (got.front == f)], got[(got.kind == "up") & (got.front == 100 + f)]
        at = {int(x): k for k, x in enumerate(ids)}
        full = np.zeros((len(own) + len(up), len(ids)))
        for k, (_, g) in enumerate([*own.groupby("row"), *up.groupby("row")]):
            full[k, [at[c] for c in g.col]] = g.v
        assert np.allclose(full.T @ full, a.T @ a) and (own[own.row == own.col].v > 0).all()
        rank = np.linalg.matrix_rank(a[:, :p]) if a.size else 0
        assert own.row.nunique() == rank and len(got[(got.kind == "dead") & (got.front == f)]) == p - rank


def test_fronts_of_a_task_share_cholesky_calls(monkeypatch):
    rnd, calls, plain = np.random.default_rng(3), [], np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda m: calls.append(len(m)) or plain(m))
    entries, plan, want = [], [], {}
    for f in range(80):
        n, p = 3, 1 + f % 2
        ids = np.sort(rnd.permutation(50)[:n])
        b = rnd.standard_normal((n, 5))
        want[f] = b @ b.T, {int(x): k for k, x in enumerate(ids)}
        plan += [(f, 200 + f, ids[k], k if k < p else -1) for k in range(n)]
        entries += [(f, ids[j], ids[i], want[f][0][i, j]) for i in range(n) for j in range(i + 1)]
    got = factor._front_chol(pd.DataFrame(entries, columns=["front", "i", "j", "v"]).sample(frac=1, random_state=1),
                             pd.DataFrame(plan, columns=["front", "parent", "id", "k"]).sample(frac=1, random_state=2))
    assert calls == [40, 40]
    for f, (s, at) in want.items():
        l, up = np.zeros((3, 3)), np.zeros((3, 3))
        for part, kind, front in ((l, "l", f), (up, "up", 200 + f)):
            x = got[(got.kind == kind) & (got.front == front)]
            part[[at[i] for i in x.i], [at[j] for j in x.j]] = x.v
        assert np.allclose(l @ l.T + up + np.tril(up, -1).T, s)


def test_steps_take_the_panels_that_a_stack_holds(spark):
    """Two panels a step, then one: R, Q' and Q agree with the matrix; by default all of them are one step."""
    r = np.random.default_rng(2)
    m = r.standard_normal((30, 11)) * (r.random((30, 11)) < 0.7)
    m[:11] += np.eye(11)
    m[:, 6] = m[:, 2]
    a = cut(table(spark, [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]))
    y = cut(table(spark, [(i, 0, float(i % 5)) for i in range(30)], "i bigint, c bigint, v double"))
    assert panels.Sizes(panel=4, rows=8, fan=2).width >= 11
    qr = panels.kept_qr(a, tol=1e-9, sizes=panels.Sizes(panel=4, rows=8, fan=2, held=128))
    rr = np.zeros((11, 11))
    for x in qr.r.collect():
        rr[x.row_id, x.col] = x.v
    assert np.allclose(rr.T @ rr, m.T @ m) and qr.dead.count() == 1 and len(qr.levels[0].nodes) == 2
    back = {x.i: x.v for x in panels.apply_q(qr, *panels.apply_qt(qr, y)).collect()}
    assert np.allclose([back.get(i, 0.0) for i in range(30)], [i % 5 for i in range(30)])
    f = r.standard_normal((90, 70))
    f[:, 40] = f[:, 3]
    v, t, live = panels.reflect(f, 1e-9)
    q = np.eye(90) - v @ t @ v.T
    assert np.allclose(q @ q.T, np.eye(90)) and live == [k for k in range(70) if k != 40] and np.allclose((q.T @ f)[69:], 0)
