"""Regressions of the fourth round: random graphs, products and row similarity at size."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.core import mix
from loomgraph.core.session import local_session
from loomgraph.operators import matrix, sample, textmatrix


@pytest.fixture(scope="module")
def spark():
    return local_session(4)


def drawn(*keys, seed):
    h = seed + 7
    for k in keys:
        h = ((h + k % mix.PRIME) * mix.MULTIPLIERS[0] + 11) % mix.PRIME
        h = (h * h % mix.PRIME + h * mix.MULTIPLIERS[1]) % mix.PRIME
    return (h + 1) / (mix.PRIME + 1)


@pytest.mark.parametrize("directed", [True, False])
def test_random_graph_walks_rows_without_stored_rounds(spark, monkeypatch, directed):
    def stored(df):
        raise AssertionError("a round of jumps was stored")

    monkeypatch.setattr(sample, "cut", stored)
    ids, want = [*range(30), 3, None, -4], []
    for i in filter(lambda i: i is not None, ids):
        at, k = (-1 if directed else i), 0
        while at < len(ids):
            at += 1 + math.floor(math.log(drawn(i, k, seed=5)) / math.log(1 - 0.4))
            k += 1
            if at < len(ids) and at != i:
                want += [(i, at)] if directed else [(i, at), (at, i)]
    got = sample.gnp_edges(spark.createDataFrame([(i,) for i in ids], "id bigint"), 0.4, directed, 5, max_gap=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("pack", [1024, 3])
@pytest.mark.parametrize("mode", [1, 0, -1])
def test_products_lay_columns_out_by_row(spark, monkeypatch, pack, mode):
    """Nulls, repeated entries and a crowded column; entries no longer meet in a join dealt by column."""
    monkeypatch.setattr(matrix, "PACK", pack, raising=False)
    rnd = random.Random(4)
    rows = [(rnd.choice([*range(12), None]), rnd.choice([*range(9), None]), rnd.choice([1.0, 2.0, -3.0, None])) for _ in range(60)]
    rows += [(i, 20, 1.0) for i in range(14)]
    want = {}
    for i, j, v in rows:
        for i2, j2, v2 in rows:
            if j is not None and j == j2 and j % 2 == 0 and not (mode < 0 and (i is None or i2 is None or i == i2)):
                p = None if v is None or v2 is None else v * v2
                old = want.get((i, i2))
                want[i, i2] = old if p is None else p + (old or 0)
    fset = spark.createDataFrame([(k,) for k in range(0, 30, 2)], "id bigint")
    got = matrix.aat(spark.createDataFrame(rows, "i bigint, j bigint, v double"), fset, mode)
    rows = list(map(tuple, got.collect()))
    assert len(set(r[:2] for r in rows)) == len(rows)
    assert set(rows) == ({(*k, v) for k, v in want.items()} if mode > 0 else set(want))
    assert "rangepartitioning" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [50_000, 2])
@pytest.mark.parametrize("kind", ["COS", "JAC", "MIN", "AMIN"])
def test_similar_rows_are_summed_where_rows_lie(spark, monkeypatch, few, kind):
    """Nulls on either side; no sum of a (query, row) is dealt out again while the queries are few."""
    monkeypatch.setattr(textmatrix, "FEW", few, raising=False)
    rnd = random.Random(6)
    a = {(i, j): float(rnd.randrange(1, 5)) for i in [*range(25), None] for j in "abcdefg" if rnd.random() < .5}
    q = {(k, j): float(rnd.randrange(1, 5)) for k in range(4) for j in "abcdefgz" if rnd.random() < .6}
    mass = (lambda v: v * v) if kind == "JAC" else (lambda v: v)
    term = min if "MIN" in kind else (lambda x, y: x * y)
    want = []
    for k in range(4):
        best = []
        for i in [*range(25), None]:
            s = [term(v, q[k, j]) for (x, j), v in a.items() if x == i and (k, j) in q]
            if not s or (i is None and kind in ("JAC", "MIN")):
                continue
            rn, qn = sum(mass(v) for (x, _), v in a.items() if x == i), sum(mass(v) for (x, _), v in q.items() if x == k)
            best.append((-{"COS": sum(s), "AMIN": sum(s) / qn}.get(kind, sum(s) / ((rn + qn - sum(s)) or 1)), i is not None, i or 0, i))
        want += [(k, i, r, round(-s, 9)) for r, (s, _, _, i) in enumerate(sorted(best)[:3])]
    got = textmatrix.similar_rows(spark.createDataFrame([*((*k, v) for k, v in a.items()), (99, None, 9.0)], "i bigint, j string, v double"),
                                  spark.createDataFrame([(*k, v) for k, v in q.items()], "q bigint, j string, v double"), 3, kind)
    assert sorted(((r.q, r.i, r.rank, round(r.sim, 9)) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert bool(re.search(r"hashpartitioning\(q#\d+L?, i#", plan)) == (few == 2)
