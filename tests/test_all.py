"""Literal fixtures, reader round trips, and registered queries against their SQL on the smallest data."""
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check  # noqa: E402
from loomgraph.core.ranges import global_index, rank_in_group, running  # noqa: E402
from loomgraph.core.session import local_session  # noqa: E402
from loomgraph.operators import edges as E  # noqa: E402
from loomgraph.operators import pool as P  # noqa: E402
from loomgraph.operators import reduce as R  # noqa: E402
from loomgraph.operators import transforms as T  # noqa: E402
from loomgraph.plans import catalog  # noqa: E402
from loomgraph.sources import text as S  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def edges(spark, pairs, w=None):
    w = w or [1.0] * len(pairs)
    return spark.createDataFrame([(a, b, float(x)) for (a, b), x in zip(pairs, w)], "src bigint, dst bigint, w double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sums_split_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(1).alias("g"), F.col("id"))
    got = rank_in_group(df, ["g"], [F.col("id").desc()]).filter("g = 0")
    assert got.agg(F.sum(F.col("rank") + F.col("id"))).first()[0] == 899 * 900
    assert rows(global_index(spark.range(5).select("id"), [F.col("id").desc()])) == [(k, 4 - k) for k in range(5)]
    s = running(spark.range(10).select("id"), [], [F.col("id")], {"s": F.col("id")})
    assert rows(s)[-1] == (9, 45)


def test_loops(spark):
    e = edges(spark, [(0, 1), (1, 0), (0, 0)], [.5, .5, .5])
    n = spark.range(2)
    assert rows(E.add_remaining_self_loops(e, n)) == [(0, 0, .5), (0, 1, .5), (1, 0, .5), (1, 1, 1.0)]
    assert E.add_self_loops(e, n).count() == 5


def test_subgraph_and_hops(spark):
    path = [(a, a + 1) for a in range(6)] + [(a + 1, a) for a in range(6)]
    sub = spark.createDataFrame([(3, 0), (4, 1), (5, 2)], "id bigint, pos bigint")
    assert rows(E.subgraph_relabelled(edges(spark, path), sub).select("src", "dst")) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    g = edges(spark, [(0, 2), (1, 2), (2, 4), (3, 4), (4, 6), (5, 6)])
    nodes, sub = E.k_hop_subgraph(g, spark.createDataFrame([(6,)], "id bigint"), 2)
    assert rows(nodes.select("id")) == [(2,), (3,), (4,), (5,), (6,)]
    assert rows(sub.select("src", "dst")) == [(2, 4), (3, 4), (4, 6), (5, 6)]


def test_isolated(spark):
    e = edges(spark, [(0, 2), (2, 0), (1, 1), (0, 0), (2, 2)], [1, 2, 3, 4, 5])
    assert rows(E.remove_isolated_nodes(e)[0]) == [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 5.0)]


def test_laplacian_and_cut(spark):
    e = edges(spark, [(0, 1), (1, 0), (1, 2), (2, 1)], [1, 2, 2, 4])
    assert rows(R.get_laplacian(e, spark.range(3))) == [(0, 0, 1.0), (0, 1, -1.0), (1, 0, -2.0), (1, 1, 4.0), (1, 2, -2.0), (2, 1, -4.0), (2, 2, 4.0)]


def test_two_hop_and_line_graph(spark):
    star = edges(spark, [(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)], [1, 2, 3, 1, 2, 3])
    assert [r[2] for r in rows(T.two_hop(star))] == [1, 2, 3, 1, 0, 0, 2, 0, 0, 3, 0, 0]
    g = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 0)])
    assert rows(T.line_graph_directed(g)) == [(0, 1), (1, 2), (1, 3), (2, 0), (3, 4), (4, 0)]


def test_topk(spark):
    n = spark.createDataFrame([(i, float(s), b) for i, (s, b) in enumerate(zip([2, 4, 5, 6, 2, 9], [0, 0, 1, 1, 1, 1]))], "id bigint, s double, graph_id bigint")
    assert [r[0] for r in P.topk(n, "s", 0.5).orderBy("graph_id", "rank").select("id").collect()] == [1, 5, 3]
    assert [r[0] for r in P.topk(n, "s", 3).orderBy("graph_id", "rank").select("id").collect()] == [1, 0, 5, 3, 2]


def test_greedy_matching_equals_sequential(spark):
    import random
    rnd = random.Random(1)
    e = [(rnd.randrange(40), rnd.randrange(40), rnd.random()) for _ in range(160)]
    e = [(a, b, w) for a, b, w in {(a, b): (a, b, w) for a, b, w in e}.values()]
    used, want = set(), set()
    for a, b, w in sorted(e, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame(e, "src bigint, dst bigint, w double")
    got = P.dominant_matching(df, spark.range(40), [(-F.col("w")).alias("neg")])
    assert {tuple(r) for r in got.collect()} == want


def test_readers(spark, tmp_path):
    m = tmp_path / "a.mtx"
    m.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 3\n2 1\n3 2\n3 3\n")
    a, meta = S.read_matrix_market(spark, str(m))
    assert (meta.nrow, meta.symmetric) == (3, True)
    assert rows(a) == [(0, 0, 3.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 3.0), (1, 2, -1.0), (2, 1, -1.0), (2, 2, 3.0)]
    g = tmp_path / "a.graph"
    g.write_text("3 2\n2\n1 3\n2\n")
    assert rows(S.read_adjacency_graph(spark, str(g))[1].select("src", "dst")) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    S.write_matrix_market(a, 3, 3, str(tmp_path / "out"))
    back, _ = S.read_matrix_market(spark, str(tmp_path / "out"))
    assert rows(back) == rows(a)


SMALL = ["add_remaining_self_loops", "remove_isolated_nodes", "gcn_norm", "softmax_by_target", "gcn_conv", "gat_conv", "topk_ratio",
         "pool_edge", "two_hop", "wl_conv", "knn_graph", "aat", "node_features", "csr_low_filter", "last_k_neighbors", "temporal_split", "roc_auc"]


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, name):
    note, _ = check.compare(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], check.connect(DATA))
    assert note is None


def test_matrix_market_variants(spark, tmp_path):
    def read(name, text):
        f = tmp_path / name
        f.write_text(text)
        return rows(S.read_matrix_market(spark, str(f))[0])
    assert read("g.mtx", "%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 5\n2 2 6\n3 3 3\n") == [(0, 0, 5.0), (1, 1, 6.0), (2, 2, 3.0)]
    assert read("s.mtx", "%%MatrixMarket matrix array real symmetric\n3 3\n1\n2\n3\n4\n5\n6\n") == sorted(
        [(0, 0, 1.0), (1, 0, 2.0), (0, 1, 2.0), (2, 0, 3.0), (0, 2, 3.0), (1, 1, 4.0), (2, 1, 5.0), (1, 2, 5.0), (2, 2, 6.0)])
    assert read("k.mtx", "%%MatrixMarket matrix array real skew-symmetric\n3 3\n2\n3\n5\n") == sorted(
        [(1, 0, 2.0), (0, 1, -2.0), (2, 0, 3.0), (0, 2, -3.0), (2, 1, 5.0), (1, 2, -5.0)])
    assert read("c.mtx", "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 4\n") == [(0, 1, -4.0), (1, 0, 4.0)]
    assert read("h.mtx", "%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1 0\n2 1 4 7\n") == [(0, 0, 1.0, 0.0), (0, 1, 4.0, -7.0), (1, 0, 4.0, 7.0)]


def test_least_squares_with_any_row_ids(spark):
    import numpy as np

    from loomgraph.operators.factor import least_squares
    r = np.random.default_rng(3)
    cells = [(i, j, float(r.standard_normal())) for i in (10, 11, 12) for j in (0, 5)] + [(i, j, float(r.standard_normal())) for i in (0, 1, 2, 3) for j in (5, 6)]
    ids, cols = [0, 1, 2, 3, 10, 11, 12], [0, 5, 6]
    b = {i: float(r.standard_normal()) for i in ids}
    m = np.zeros((7, 3))
    for i, j, v in cells:
        m[ids.index(i), cols.index(j)] = v
    want = np.linalg.lstsq(m, np.array([b[i] for i in ids]), rcond=None)[0]
    got = least_squares(spark.createDataFrame(cells, "i bigint, j bigint, v double"), spark.createDataFrame([(i, 0, v) for i, v in b.items()], "i bigint, c bigint, v double"))
    assert np.allclose([x[-1] for x in rows(got)], want)


def test_streams_equal_batch_in_any_file_order(spark, tmp_path):
    from loomgraph.streaming import jobs as J
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n = events.count()
    for k in range(24):   # newest events come in the first files
        events.filter(F.floor(F.col("event_id") * 24 / n) == 23 - k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = J.run_tumbling(spark, str(tmp_path), "1 day")
    assert got.agg(F.sum("n")).first()[0] == n
    got = J.run_sessions(spark, str(tmp_path), "2 hours")
    assert got.agg(F.sum("n")).first()[0] == n and got.select("src", "start").distinct().count() == got.count()


def test_negatives_of_nearly_full_sources(spark):
    from loomgraph.operators.sample import structured_negatives
    e = edges(spark, [(0, d) for d in range(6) if d != 4] + [(1, d) for d in range(6)]).select("src", "dst")
    got = structured_negatives(e, 6, rounds=1).collect()
    assert len(got) == 11 and {r.neg for r in got if r.src == 0} == {4} and {r.neg for r in got if r.src == 1} == {None}


def test_undirected_negatives_avoid_every_edge(spark):
    data = "/root/testdata/sf0.01"   # nine pairs are free there, none in the smaller one
    li = spark.read.parquet(f"{data}/lineitem.parquet")
    n = li.agg(F.max("l_suppkey") + 1).first()[0]
    held = {tuple(r) for r in li.select("l_suppkey", F.col("l_partkey") % n).distinct().collect()}
    free = {(a, b) for a in range(n) for b in range(a + 1, n)} - held
    assert free and rows(catalog.queries()["negative_edges_undirected"](spark, data)) == sorted(free | {(b, a) for a, b in free})


@pytest.mark.parametrize("name", ["partition_kway_total", "partition_mesh_nodal", "partition_mesh_dual"])
def test_partition_queries_coarsen_and_refine_in_full(spark, monkeypatch, name):
    import inspect

    from loomgraph.operators import traverse
    whole, seen = traverse.partition_kway, []

    def noted(edges, nodes, k, *args, **kw):
        call = inspect.signature(whole).bind(edges, nodes, k, *args, **kw)
        call.apply_defaults()
        seen.append((call.arguments["rounds"], call.arguments["levels"]))
        return nodes.select("id", F.lit(0).alias("part"))   # the partition itself isn't needed here

    monkeypatch.setattr(traverse, "partition_kway", noted)
    catalog.queries()[name](spark, DATA)
    given = inspect.signature(whole).parameters
    assert seen == [(given["rounds"].default, given["levels"].default)]


def test_limits_that_are_hit_raise(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (2, 0)]), spark.range(3)
    with pytest.raises(ValueError, match="2 rounds"):
        T.personalized_pagerank_push(e, n, 0.1, 1e-3, max_rounds=2)
    nodes = n.select(F.lit(0).alias("graph_id"), "id", F.lit(1.0).alias("v"))
    for dense in (lambda size: E.to_dense_batch(nodes, "v", size=size), lambda size: E.to_dense_adj(nodes, e, size)):
        assert dense(3).count() == 3
        with pytest.raises(ValueError, match="3 nodes"):
            dense(2)


def test_mesh_dual_meets_on_pairs_of_nodes(spark):
    import random
    from loomgraph.operators.traverse import mesh_to_dual
    # 60000 elements of three nodes share node 0 and nothing else: over single nodes that made 3.6e9 pairs
    hub = spark.range(1, 60001).select(F.col("id").alias("elem"), F.explode(F.array(F.lit(0), F.col("id") * 2, F.col("id") * 2 + 1)).alias("node"))
    twin = spark.createDataFrame([(70000, 0), (70000, 2), (70000, 9000000)], "elem bigint, node bigint")
    assert rows(mesh_to_dual(hub.unionAll(twin), 2)) == [(1, 70000), (70000, 1)]
    draw = random.Random(3)
    sets = {e: set(draw.sample(range(40), draw.choice([1, 2, 3, 4, 7, 20]))) for e in range(60)}
    m = spark.createDataFrame([(e, n) for e, s in sets.items() for n in s] * 2, "elem bigint, node bigint")
    for common in (1, 2, 3):
        want = [(a, b) for a, s in sets.items() for b, t in sets.items() if a != b and s & t
                and (len(s & t) >= common or len(s & t) >= min(len(s), len(t)) - 1)]
        assert rows(mesh_to_dual(m, common)) == sorted(want)


def test_power_iteration_makes_its_operator_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    e = edges(spark, [(a, b) for a in range(3) for b in range(3)], [2, -1, 0, -1, 2, -1, 0, -1, 2]).mapInArrow(passed, "src bigint, dst bigint, w double")
    assert abs(T.largest_eigenvalue(e, spark.range(3), 30) - (2 + 2 ** .5)) < 1e-3
    assert seen.value == 9
