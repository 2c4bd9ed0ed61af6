"""Regressions of the third round: greedy rounds, pushes, itemless rows."""
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.core.session import local_session
from loomgraph.operators import pool, transforms, traverse
from loomgraph.streaming import jobs


@pytest.fixture(scope="module")
def spark():
    return local_session(4)


def greedy(rows):
    met, out = set(), []
    for w, s, d in sorted((-w, s, d) for s, d, w in rows):
        if s not in met and d not in met:
            met |= {s, d}
            out.append((s, d))
    return sorted(out)


@pytest.mark.parametrize("in_one", [2000, 200])
def test_matching_in_few_rounds(spark, monkeypatch, in_one):
    """Equal weights: ties by id wait for each other in a chain, a round an edge before."""
    monkeypatch.setattr(pool, "IN_ONE", in_one, raising=False)
    rnd = random.Random(5)
    pairs = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(700)} | {(i, i + 1) for i in range(200, 320)}
    rows = [(s, d, float(rnd.choice([1, 1, 1, 2]))if s < 120 else 1.0) for s, d in sorted(pairs)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    calls = []
    real = pool.cut
    monkeypatch.setattr(pool, "cut", lambda df: calls.append(1) or real(df))
    got = pool.dominant_matching(edges, edges.select(F.col("src").alias("id")), [(-F.col("w")).alias("neg")])
    assert sorted(map(tuple, got.collect())) == greedy(rows)
    assert len(calls) < 60


def pushes(rows, ids, alpha, eps):
    out = {i: [d for s, d in rows if s == i] for i in ids}
    got = {}
    for root in ids:
        p, r = {}, {root: alpha}
        while hot := {i: x for i, x in r.items() if out[i] and x > alpha * eps * len(out[i])}:
            for i, x in hot.items():
                p[i] = p.get(i, 0) + x
                r[i] -= x
            for i, x in hot.items():
                for d in out[i]:
                    r[d] = r.get(d, 0) + (1 - alpha) * x / len(out[i])
        got |= {(root, i): round(x, 9) for i, x in p.items()}
    return got


@pytest.mark.parametrize("part", [256, 5])
def test_pushes_of_small_parts_need_no_joined_rounds(spark, monkeypatch, part):
    monkeypatch.setattr(transforms, "PUSH_PART", part)
    rnd = random.Random(3)
    rows = [(10 * g + rnd.randrange(3 + g), 10 * g + rnd.randrange(3 + g)) for g in range(6) for _ in range(9)]
    ids = [10 * g + k for g in range(6) for k in range(3 + g)]
    cuts = []
    real = transforms.cut
    monkeypatch.setattr(transforms, "cut", lambda df: cuts.append(1) or real(df))
    got = transforms.personalized_pagerank_push(spark.createDataFrame(rows, "src bigint, dst bigint"),
                                                spark.createDataFrame([(i,) for i in ids], "id bigint"), 0.2, 1e-3).collect()
    assert {(r.src, r.dst): round(r.w, 9) for r in got} == pushes(rows, ids, 0.2, 1e-3) and len({(r.src, r.dst) for r in got}) == len(got)
    if part == 256:
        assert len(cuts) < 6


def test_streamed_last_neighbours_keep_no_python_state(spark, tmp_path):
    """Several batches; a hub, equal times, and a plan without a Python state per key."""
    rnd = random.Random(8)
    rows = [(e, f"2024-01-{1 + rnd.randrange(9):02d} 00:00:00", rnd.randrange(4), rnd.choice(["click", "view"]), 1.0) for e in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, jobs.run_last_k(spark, str(tmp_path), 3).collect()))
    code, by = {"click": 1, "view": 9}, {}
    for e, ts, u, kind, _ in rows:
        for node, other in ((2 * u, code[kind]), (code[kind], 2 * u)):
            by.setdefault(node, []).append((ts, e, other))
    assert got == sorted((n, o, e) for n, x in by.items() for _, e, o in sorted(x, reverse=True)[:3])
    assert not hasattr(jobs, "_keep_last")


def test_check_graph_reads_its_edges_once(spark):
    rows = [(1, 2, 1.0), (2, 1, 1.0), (2, 1, 1.0), (1, 3, 1.0), (3, 1, 2.0), (4, 4, 1.0), (4, 4, None), (5, 6, None), (6, 5, None),
            (None, 5, 1.0), (5, None, 1.0), (None, 5, 1.0), (7, 8, 0.0), (8, 7, -0.0), (9, 8, float("nan")), (8, 9, float("nan"))]
    got = traverse.check_graph(spark.createDataFrame(rows, "src bigint, dst bigint, w double"))
    assert tuple(got.first()) == (2, 3, 8)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_powers_read_their_edges_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(w):
        seen.add(1)
        return w

    edges = spark.createDataFrame([(0, 1, .5), (1, 0, .5), (1, 2, 1.0)], "src bigint, dst bigint, w double").select("src", "dst", counted("w").alias("w"))
    got = transforms.diffusion_powers(edges, spark.range(3), [1.0, 1.0, 1.0])
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.25), (0, 1, .5), (0, 2, .5), (1, 0, .5), (1, 1, 1.25), (1, 2, 1.0), (2, 2, 1.0)]
    assert seen.value == 3
