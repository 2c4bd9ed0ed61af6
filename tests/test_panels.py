"""Block QR and Cholesky with kept reflectors against numpy, in one front and over front trees."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.core.session import cut
from loomgraph.operators import factor as X
from loomgraph.operators import panels as P
from loomgraph.operators.elimination import column_minimum_degree

SMALL = P.Sizes(panel=4, rows=8, fan=2)


@pytest.fixture(scope="module")
def spark():
    from loomgraph.core.session import local_session
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark, m, names="i bigint, j bigint, v double"):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], names)


def dense(df, shape, *cols):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[cols[0]], r[cols[1]]] += r[cols[2]]
    return out


def columns(spark, m, name):
    return spark.createDataFrame([(int(i), int(c), float(m[i, c])) for i in range(m.shape[0]) for c in range(m.shape[1])], f"{name} bigint, c bigint, v double")


def test_reflectors_are_orthogonal():
    r = np.random.default_rng(0)
    f = r.standard_normal((12, 5))
    f[:, 3] = f[:, 1] * 2
    v, t, live = P.reflect(f, 1e-9)
    q = np.eye(12) - v @ t @ v.T
    assert np.allclose(q @ q.T, np.eye(12)) and live == [0, 1, 2, 4]
    assert np.allclose(P.turned(v, t, f, True), q.T @ f) and np.allclose((q.T @ f)[4:], 0)


@pytest.mark.parametrize("tree", [False, True])
def test_kept_qr(spark, tree):
    r = np.random.default_rng(2)
    m = r.standard_normal((37, 11)) * (r.random((37, 11)) < (0.25 if tree else 0.7))
    m[:11] += np.eye(11)
    m[:, 6] = m[:, 2]                       # one dead column
    a = cut(table(spark, m))
    qr = P.kept_qr(a, column_minimum_degree(a) if tree else None, tol=1e-9, sizes=SMALL)
    rr = dense(qr.r, (11, 11), "row_id", "col", "v")
    assert np.allclose(rr.T @ rr, m.T @ m, atol=1e-8) and qr.dead.count() == 1
    y = r.standard_normal((37, 2))
    rows = {x.i for x in a.select("i").distinct().collect()}
    y[[i for i in range(37) if i not in rows]] = 0
    got, rest = P.apply_qt(qr, columns(spark, y, "i"))
    z = dense(got, (11, 2), "row_id", "c", "v")
    assert np.allclose(rr.T @ z, m.T @ y, atol=1e-8)                                   # R' Q' y = A' y
    spare = rest.groupBy("c").agg(F.sum(F.col("v") ** 2).alias("s")).collect()
    assert np.allclose((z ** 2).sum(0) + [x.s for x in sorted(spare)], (y ** 2).sum(0))   # lengths stay
    assert np.allclose(dense(P.apply_q(qr, got, rest), (37, 2), "i", "c", "v"), y, atol=1e-8)   # Q Q' y = y
    w = r.standard_normal((11, 1))
    w[[x.id for x in qr.dead.collect()]] = 0
    qw = dense(P.apply_q(qr, columns(spark, w, "row_id")), (37, 1), "i", "c", "v")
    assert np.isclose(np.linalg.norm(qw), np.linalg.norm(w)) and np.allclose(m.T @ qw, rr.T @ w, atol=1e-8)
    live = [k for k in range(11) if rr[k, k]]
    x = dense(P.solve_r(qr, columns(spark, w, "id")), (11, 1), "id", "c", "v")
    assert np.allclose(rr[np.ix_(live, live)] @ x[live], w[live], atol=1e-7)
    x = dense(P.solve_r(qr, columns(spark, w, "id"), transposed=True), (11, 1), "id", "c", "v")
    assert np.allclose(rr[np.ix_(live, live)].T @ x[live], w[live], atol=1e-7)
    x = dense(P.least_squares(qr, columns(spark, y, "i")), (11, 2), "id", "c", "v")
    assert np.allclose(m.T @ (m @ x), m.T @ y, atol=1e-7)
    t, perm = P.trapezoidal(qr)
    tt = dense(t, (11, 11), "row_pos", "col_pos", "v")
    pos = {p.col: p.pos for p in perm.collect()}
    by = [pos[c] for c in range(11)]
    assert np.allclose((tt.T @ tt)[np.ix_(by, by)], m.T @ m, atol=1e-8)
    assert np.allclose(np.tril(tt, -1), 0) and (np.diag(tt)[:10] != 0).all() and not tt[10:].any()


def test_lq_and_least_norm(spark):
    r = np.random.default_rng(3)
    m = r.standard_normal((9, 30)) * (r.random((9, 30)) < 0.6)
    lq = P.kept_lq(table(spark, m), sizes=SMALL)
    l = dense(lq.l, (9, 9), "i", "k", "v")
    assert np.allclose(l @ l.T, m @ m.T) and np.allclose(np.triu(l, 1), 0)
    y = r.standard_normal((30, 1))
    assert np.allclose(l @ dense(lq.apply_q(columns(spark, y, "i")), (9, 1), "row_id", "c", "v"), m @ y)
    b = r.standard_normal((9, 1))
    x = dense(P.least_norm(lq.qr, columns(spark, b, "id")), (30, 1), "i", "c", "v")
    assert np.allclose(x, np.linalg.lstsq(m, b, rcond=None)[0], atol=1e-8)


def test_block_cholesky(spark):
    r = np.random.default_rng(4)
    m = r.standard_normal((14, 14))
    m = m @ m.T + 14 * np.eye(14)
    half = table(spark, np.tril(m)).withColumn("front", F.lit(5).cast("bigint"))
    plan = spark.createDataFrame([(5, k, k if k < 9 else -1) for k in range(14)], "front bigint, id bigint, k bigint")
    l, up = P.block_cholesky(half, plan, SMALL)
    want = np.linalg.cholesky(m)
    assert np.allclose(dense(l, (14, 14), "i", "j", "v"), np.where(np.arange(14) < 9, want, 0))
    s = m - want[:, :9] @ want[:, :9].T
    assert np.allclose(dense(up, (14, 14), "i", "j", "v")[9:, 9:], np.tril(s[9:, 9:]))


def test_wide_fronts_go_by_blocks(spark, monkeypatch):
    """Fronts above the block bound give the same factor as fronts held by one task."""
    r = np.random.default_rng(6)
    m = r.standard_normal((24, 12)) * (r.random((24, 12)) < 0.3)
    m[:12] += np.eye(12)
    a = cut(table(spark, m))
    s = column_minimum_degree(a)
    spd = m.T @ m + np.eye(12)
    b = cut(table(spark, spd))
    monkeypatch.setattr(X, "WIDE", 4)
    monkeypatch.setattr(X, "Sizes", lambda: SMALL)
    got = X.qr_factor(a, s)
    rr = dense(got.r, (12, 12), "row_id", "col", "v")
    assert np.allclose(rr.T @ rr, m.T @ m, atol=1e-8) and got.dead.count() == 0
    l = dense(X.cholesky(b).l, (12, 12), "i", "j", "v")
    assert np.allclose(l @ l.T, spd, atol=1e-8)


def test_refreshed_pattern_equals_fresh_analysis(spark):
    from loomgraph.operators.elimination import refreshed_pattern, symbolic_of_order
    r = np.random.default_rng(8)
    full = {(i, j) for i in range(16) for j in range(i) if r.random() < 0.2} | {(i + 1, i) for i in range(0, 15, 2)}
    lost = {e for e in full if r.random() < 0.3}
    order = spark.createDataFrame([(i, i) for i in range(16)], "id bigint, pos bigint")
    both = lambda es: spark.createDataFrame([p for a, b in es for p in ((a, b), (b, a))], "src bigint, dst bigint")
    old, fresh = (symbolic_of_order(both(es), order).pattern() for es in (full, full - lost))
    changed = spark.createDataFrame([(j,) for _, j in lost], "id bigint")
    got = refreshed_pattern(cut(old), order, both(full - lost), changed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fresh.collect()))


def test_hub_elements_are_found_inside_without_joining_over_the_hub(spark):
    """40000 leaves on one hub: their elements hold the hub alone; joined over it they made 1.6e9 rows a step"""
    from loomgraph.operators.elimination import _covered, _inside, minimum_degree
    leaves = spark.range(1, 40001).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    star = leaves.unionAll(leaves.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    assert minimum_degree(star, spark.range(40001)).totals().first()["lnz"] == 80001
    rng = np.random.default_rng(4)
    pick = lambda names, top: [(e, int(i)) for e in names for i in set(rng.integers(0, 12, rng.integers(1, top)))]
    old, fresh = pick(range(100, 160), 5), pick(range(20), 10)
    sets = lambda rows: {e: {i for f, i in rows if f == e} for e, _ in rows}
    table = lambda rows: spark.createDataFrame(rows, "elem bigint, id bigint")
    want = {e: min(f for f, t in sets(fresh).items() if s <= t) for e, s in sets(old).items() if any(s <= t for t in sets(fresh).values())}
    assert {r.elem: r.front for r in _inside(table(old), table(fresh)).collect()} == want
    pairs = [(a, b) for a in range(12) for b in range(12) if a != b and (a * b) % 3]
    got = _covered(spark.createDataFrame(pairs, "a bigint, b bigint"), table(fresh)).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b in pairs if any({a, b} <= t for t in sets(fresh).values())}


def test_each_connected_part_is_a_front(spark):
    m = np.zeros((7, 4))
    m[:4, [0, 2]], m[4:, [1, 3]] = [[1, 2], [3, 1], [2, 2], [1, 5]], [[2, 1], [1, 1], [4, 1]]
    qr = P.kept_qr(table(spark, m), sizes=SMALL)
    assert {(r["id"], r["front"]) for r in qr.pivots.collect()} == {(0, 0), (2, 0), (1, 1), (3, 1)}
    r = np.zeros((4, 4))
    for x in qr.r.collect():
        r[x["row_id"], x["col"]] = x["v"]
    assert np.allclose(r.T @ r, m.T @ m) and np.allclose(r, np.triu(r))
