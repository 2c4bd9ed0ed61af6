"""Connected parts that end in one task: same result as by joined rounds, and no joined round for small parts."""
import random

import pytest

from loomgraph.core.session import local_session
from loomgraph.operators import elimination as E


@pytest.fixture(scope="module")
def spark():
    return local_session(4)


def mixed(seed):
    """parts of several shapes: a random graph, paths, rows as elements, lone nodes"""
    r = random.Random(seed)
    edges = {(a, b) for a in range(9) for b in range(a) if r.random() < 0.3} | {(k, k + 1) for k in range(20, 26)} | {(k, k + 1) for k in range(30, 36)}
    rows = [(n, k) for n in range(7) for k in r.sample(range(40, 49), 3)] + [(7, 3), (7, 44)] * (seed % 2)
    ids = [*range(9), *range(20, 27), *range(30, 37), *range(40, 49), 99]
    return ids, [(a, b) for a, b in edges] + [(b, a) for a, b in edges], rows, {i: r.randrange(3) for i in ids}, dict(zip(ids, r.sample(range(1000), len(ids))))


def facts(s):
    pairs = lambda df: sorted(tuple(x) for x in df.collect())
    return pairs(s.pivots.select("front", "id", "k", "round")), pairs(s.rest.select("front", "id")), pairs(s.absorbed.select("elem", "front"))


@pytest.mark.parametrize("seed,fixed,limit", [(1, True, 0), (3, False, 30)])
def test_parts_end_as_in_joined_rounds(spark, monkeypatch, seed, fixed, limit):
    ids, edges, rows, cls, pos = mixed(seed)
    v = spark.createDataFrame([(i, pos[i]) if fixed else (i, cls[i]) for i in ids], f"id bigint, {'pos' if fixed else 'cls'} bigint")
    e, m = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame(rows, "row bigint, id bigint")
    got = facts(E.eliminate(v, e, m, fixed=fixed))
    monkeypatch.setattr(E, "PART_ROWS", limit)
    assert got == facts(E.eliminate(v, e, m, fixed=fixed))


def test_small_parts_need_no_joined_round(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a joined round")

    monkeypatch.setattr(E, "_inside", never)
    n = 40
    e = spark.createDataFrame([p for k in range(n - 1) for p in ((k, k + 1), (k + 1, k))], "src bigint, dst bigint")
    s = E.symbolic_of_order(e, spark.range(n).selectExpr("id", "id as pos"))
    assert s.totals().first()["lnz"] == 2 * n - 1
    assert sorted(r["id"] for r in s.order().collect()) == list(range(n))
