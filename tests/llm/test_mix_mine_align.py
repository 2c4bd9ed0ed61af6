"""Mixing, hard negatives and tokenizer alignment against brute force on awkward rows."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import align, mixing, negatives, queries

FILES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
CLASH = "size bigint, key string, target int, n bigint, copies string, rank int, groups string, pairs int"


def widened(spark, rows, schema):
    """Rows behind columns whose names clash with those of results and steps."""
    return spark.createDataFrame([(*r, 1, "k", None, 2, "c", 3, "g", 4) for r in rows], f"{schema}, {CLASH}").repartition(3)


# mixing

def say(r, n):
    return " \t".join(r.choice(["a", "bb", "é", "x y"]) for _ in range(n))


def mixed_rows():
    r = random.Random(5)
    rows = [(i, say(r, r.randint(1, 60)), f"s{r.randrange(4)}") for i in range(300)]
    rows += [(1000 + i, say(r, r.randint(1, 9)), None) for i in range(40)]
    rows += [(2000 + i, say(r, 7), "same") for i in range(50)] + [(2000, say(r, 7), "same")] * 3
    rows += [(3000, say(r, 20_000), "long"), (3001, say(r, 10), "long"), (3002, None, "long"), (None, say(r, 5), "long"), (None, None, None)]
    rows += [(4000, "", "empty"), (4001, None, "empty"), (4002, " \n", "Ω"), (4003, "word", "Ω"), (4004, "w " * 30, "")]
    return rows


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: full.get(s, level * w[s]) for s in names}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix_meets_targets(spark):
    rows = mixed_rows()
    docs = widened(spark, rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((g.doc_id, g.source, g["size"]) for g in got) == Counter((d, s, words(t)) for d, t, s in rows)
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    want, taken = brute_targets(sizes), Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source], rel=1e-9, abs=1e-9)
        assert g.taken == g.copies * g["size"] and 0 <= g.copies <= 3 and abs(g.copies - g.rate) < 1.0001 + (g["size"] < longest[g.source])
        taken[g.source] += g.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(longest[s], 1), s
    for s in ("s0", "s1", "s2", "s3", None):
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((g.doc_id, g.source, g["size"], g.taken) for g in again) == Counter((g.doc_id, g.source, g["size"], g.taken) for g in got)


def test_rates_solve_the_dual(spark):
    """The multipliers against bisection in plain Python: exponential tilt, capped, that meets the token constraint."""
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    by = defaultdict(list)
    for g in mixing.mix(docs).collect():
        by[g.source].append(g)
    for own in by.values():
        size, target = [g["size"] for g in own], own[0].target
        if not 0 < target < 3 * sum(size):
            continue
        mean, lo, hi = sum(size) / len(size), -200.0, 200.0
        give = lambda u: [min(3.0, math.exp(min(50.0, u * n / mean))) for n in size]
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * r for n, r in zip(size, give(mid))) < target else (lo, mid)
        for g, r in zip(own, give(lo)):
            assert g["size"] == 0 or g.rate == pytest.approx(r, rel=1e-6, abs=1e-9)


def test_mixed_rows_repeat(spark):
    docs = widened(spark, mixed_rows(), "doc_id bigint, text string, source string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {r.source: r.n for r in plan if r.n}
    assert mixing.mix(docs.filter("false")).count() == mixing.mixed(docs.filter("false")).count() == 0


# hard negatives

def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (5, 0, 7), (33, 64, 129), (100, 65, 67), (128, 32, 64)):
        a, b = r.integers(-1 << 20, 1 << 20, (n, k)), r.integers(-1 << 20, 1 << 20, (k, m))
        assert np.array_equal(negatives.strassen(a, b), a @ b)


def brute_negatives(rows):
    sound = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
             if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, v, lab in sound:
        if a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in sound if i != a and len(w) == len(v))
        for p, pid, _ in [x for x in s if x[2] == lab][:5]:
            fit = [(n, i) for n, i, other in s if other != lab and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out.update((a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit))
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    centre = r.standard_normal((6, 33))
    rows = []
    for i in range(900):
        lab = int(r.choice([0, 0, 0, 1, 2, 3, 9]))
        rows.append((i, [float(x) for x in centre[lab % 6] * 0.4 + r.standard_normal(33) * 0.4], lab))
    rows += [(1000, None, 1), (1050, rows[50][1], None), (1100, [None] * 33, 1), (1150, [float("nan")] * 33, 1), (None, rows[0][1], 0),
             (1200, [0.0] * 33, 0), (1250, [0.5, -0.5], 1), (1251, [0.5, -0.4], 1), (1252, [0.4, -0.3], 2), (1300, [], 1), (1301, [], 2)]
    rows += [rows[7], rows[7], rows[100]] + [(1400 + i, rows[3][1], rows[3][2]) for i in range(40)] + [(1500, [float("inf")] * 33, 2)]
    return rows


def test_negatives_equal_brute_force(spark, vectors, monkeypatch):
    want = brute_negatives(vectors)
    df = widened(spark, vectors, "vec_id bigint, embedding array<double>, label int")
    for rows, anchors in ((4096, 512), (64, 8)):   # one tile, and many
        monkeypatch.setattr(negatives, "ROWS", rows)
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        got = negatives.mine(df, F.col("vec_id") % 50 == 0).collect()
        cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert Counter(tuple(g[c] for c in cols) for g in got) == want


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine(none, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(1, [0.1], 1), (2, [0.2], 2)], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine(few, F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300], 1), (50, [0.1], 1), (2, [0.2], 1)], "vec_id bigint, embedding array<double>, label int")
    assert negatives.mine(huge, F.col("vec_id") % 50 == 0).count() == 0


# alignment

def awkward_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice(["an", "the", "ou", "é", "tion", "X", "12", "'s"]) for _ in range(r.randint(1, 4)))
    out = [None, "", " ", "  ", "x", " x", "x ", "a  b", "a b  c", "a\x1c b", "a\x00 b", "\n\n a \t b", "a ▁b", "▁", "<|endoftext|> <s> </s> <unk>", "naïve ﬁ 日本語 テキスト 🙂 🙂🙂 é"]
    out += [" ".join(word() for _ in range(n)) for n in (3, 50, 4000)] + ["ab" * 9000, "日本" * 3000, "the " * 5000]
    return out


def brute_align(code, texts):
    rows, links = [], []
    for t in texts:
        ids = (code.a.encode(" " + (t or ""), add_special_tokens=False).ids, code.b.encode(t or ""))
        parts = [[v[i] for i in x] for v, x in zip((code.bytes_a, code.bytes_b), ids)]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, own, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            new = [x.index(e) + 1 for x in ends]
            groups.append("|".join(",".join(str(i) for i in x[s:n]) for x, s, n in zip(ids, at, new)))
            own.append(tuple(x[n - 1] for x, n in zip(ids, new)))
            at = new
        rows.append((len(ids[0]), len(ids[1]), len(groups), ";".join(groups)))
        links.append(own)
    n = Counter(p for own in links for p in own)
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return [(*r, len(own), sum(n[p] == most[p[1]] for p in own), sum(n[p] for p in own)) for r, own in zip(rows, links)]


def test_alignment_equals_brute_force(spark, tmp_path, monkeypatch):
    texts = awkward_texts() + awkward_texts()[16:19] * 2
    docs = widened(spark, [(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    code = align.aligner(*FILES)
    want = brute_align(code, texts)
    rows = align.align(docs, *FILES)
    rows.write.parquet(str(tmp_path / "rows"))
    out = align.score(spark.read.parquet(str(tmp_path / "rows")), *FILES).collect()
    cols = ("n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    got = {r.doc_id: tuple(r[c] for c in cols) for r in out}
    for i, w in enumerate(want):
        assert got[i] == w, (i, repr(texts[i])[:60])
    none = align.align(docs.filter("false"), *FILES)
    assert none.count() == 0 and align.score(none, *FILES).count() == 0


def test_pointer_jumping_names_components():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 40))
        cut = lambda: np.append(np.flatnonzero(r.random(n - 1) < 0.4) + 1, n)
        a, b = cut(), cut()
        last = align.jump(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        group = lambda e: next(i for i, c in enumerate(both) if e <= c)
        names = [group(e) for e in [*a.tolist(), *b.tolist()]]
        assert [names[i] for i in last.tolist()] == names and len(set(last.tolist())) == len(both)


def test_queries_digest_their_operators(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.op13_align(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = dict(zip(texts, brute_align(align.aligner(*FILES), list(texts.values()))))
    assert len(rows) == len(texts)
    for r in rows:
        a, b, g, groups, links, best, total = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (a, b, g, links, best, total)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
