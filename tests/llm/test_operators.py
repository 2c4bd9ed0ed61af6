"""Operators against brute force on awkward rows: nulls, empty and long texts, ties, repeated rows and
ids, empty tables, and extra columns whose names clash with results."""
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, exact, forest, language, lines, near, packing, queries, suffix, urls, warc
from loomgraph.llm.common import text_key
from loomgraph.llm.words import encoder

WHITE = "[\x20\x09-\x0d]"
EXTRA = "n_lines bigint, key string, kept boolean, size int, row string"


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "the", "ou", "é", "tion", "X"]) for _ in range(r.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    line = "A licence line that many documents share, word for word."
    base = say(120)
    out = [None, "", " \t\n", "x", "a b c", base, base, base + " tail", base.replace(" ", "  ", 5), base.upper(), say(4000)]
    for i in range(14):
        w = base.split()
        for _ in range(i):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for i in range(8):
        out.append(f"{say(20)}\n {line} \n{say(5)}\n{line.upper()}\n")
    out += ["naïve café 日本語 <|endoftext|> don't stop\u0301 ÅÉ 12,5", "ab" * 700, "ab" * 700 + "c", "!!! 123", line, line]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (None, None), (5, texts()[5]), (7, "other text of a repeated id")]
    return spark.createDataFrame([(d, t, "en", None, 1, "k", True, 2, "r") for d, t in rows],
                                 f"doc_id bigint, text string, lang string, source string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(docs, none):
    code = encoder(queries.tokenizer())
    out = bpe.encode(docs, queries.tokenizer())
    got = Counter((r.doc_id, r.ids.hex(), r.t) for r in out.withColumn("t", bpe.decode(F.col("ids"), queries.tokenizer())).collect())
    want = Counter((d, np.array(code.direct(t), "<u4").tobytes().hex(), code.tok.decode(code.direct(t), skip_special_tokens=False)) for d, t in pairs(docs))
    assert got == want
    assert bpe.encode(none, queries.tokenizer()).count() == 0


def test_bpe_long_texts_and_shared_chunks(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgé'1.") for _ in range(r.randint(1, 9)))
    block = " ".join(word() for _ in range(4000))
    rows = [(i, f"{word()} {block[i * 500:i * 500 + 9000]}{word()}") for i in range(12)]
    rows += [(100, block * 60), (101, "x" * 300_000), (102, block), (103, block), (104, None), (105, "\ufdfa" * 2000 + " " + block)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    code = encoder(queries.tokenizer())
    for got in bpe.encode(docs, queries.tokenizer(), with_text=True).collect():
        assert got.decoded == code.tok.decode(code.direct(dict(rows)[got.doc_id] or ""), skip_special_tokens=False)
        assert np.frombuffer(got.ids, "<u4").tolist() == code.direct(dict(rows)[got.doc_id] or ""), got.doc_id


def test_bpe_filter_misses_no_key(spark):
    keys = spark.range(3000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    got = bpe.marked(keys, bpe.filed(keys.filter("id % 3 = 0"))).select("id", "hit").collect()
    assert len(got) == 3000 and all(r.hit for r in got if r.id % 3 == 0)
    assert sum(r.hit for r in got if r.id % 3) < 5


def test_bpe_repairs_joints():
    code, r = encoder(queries.tokenizer()), random.Random(5)
    text = " ".join("".join(r.choice("abcdefgé'1.") for _ in range(r.randint(1, 9))) for _ in range(80))
    for _ in range(60):
        cuts = sorted(r.sample(range(1, len(text)), 6))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        ends = np.cumsum([len(p.encode()) for p in parts]).tolist()
        plan = bpe.whole_words(text.encode(), [[e, None if i % 2 else np.zeros(0, np.uint32)] for i, e in enumerate(ends)])
        starts = [0, *[e for e, _ in plan[:-1]]]
        ids = [np.array(code.direct(text.encode()[a:e].decode()), np.uint32) for a, (e, _) in zip(starts, plan)]
        assert bpe.joined(code, text.encode(), [e for e, _ in plan], ids).tolist() == code.direct(text)


def test_lines(docs, none):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{WHITE}+|{WHITE}+$", "", s))
    rank = lambda d: -1 if d is None else d
    holders = {}
    for d, t in pairs(docs):
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(rank(d))
    gone = lambda d, x: len(h := holders.get(key(x), ())) >= 5 and rank(d) < max(h)
    want = Counter((d, len(t.split("\n")), sum(gone(d, x) for x in t.split("\n")), "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in pairs(docs))
    for batches in (1, 3):
        out = lines.dedup_lines(docs, batches=batches)
        assert set(out.columns) == {*docs.columns, "n_dropped"}
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == want
    assert lines.dedup_lines(none).count() == 0


def test_lines_of_a_long_document(spark, tmp_path):
    """200000 lines, every other one repeated in four more documents: one pass, not lines times drops."""
    said = lambda k: f"line number {k} that is long enough to be judged by its key"
    pairs = spark.range(100_000).agg(F.sort_array(F.collect_list("id")).alias("k"))
    shared = F.array_join(F.transform("k", lambda k: F.format_string(said("%d"), k)), "\n")
    own = F.array_join(F.transform("k", lambda k: F.concat(F.format_string(said("%d"), k), F.lit("\nown "), k.cast("string"))), "\n")
    docs = pairs.select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("doc_id"), shared.alias("s"), own.alias("o")).select(
        "doc_id", F.when(F.col("doc_id") == 0, F.col("o")).otherwise(F.col("s")).alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (200_000, 100_000)
    assert got[0].text == "\n".join(f"own {k}" for k in range(100_000))
    assert (got[1].n_dropped, got[1].text, got[4].n_dropped) == (100_000, "", 0)


def test_near_components(docs, none):
    rows, sets = pairs(docs), []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    def root(i):
        return i if up[i] == i else root(up[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = Counter((d, len(s), first[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_components(docs).collect())
    assert got == want
    assert near.near_components(none).count() == 0


def test_near_links_chains_and_large_groups(spark):
    """Neighbours in a chain are near, its ends are not; groups are settled without listing their pairs."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, chain = [], words[:60]
    for i in range(60):
        rows.append((i, " ".join(chain)))
        chain = chain[1:] + [words[60 + i]]
    for i in range(300):
        w = [f"g{j}" for j in range(80)]
        w[r.randrange(80)] = f"z{i}"
        rows.append((1000 + i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


@pytest.mark.parametrize("group", [4000, 2])
def test_suffix_strips_repeats(spark, docs, none, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows, size = [(d, t.encode()) for d, t in pairs(docs)], 60
    count = Counter(b[i:i + size] for _, b in rows for i in range(len(b) - size + 1))
    want = Counter()
    for d, b in rows:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i:i + size]] > 1:
                hit[i:i + size] = True
        want[(d, len(b), int((np.diff(np.r_[0, hit]) == 1).sum()), bytes(x for x, h in zip(b, hit) if not h).hex())] += 1
    out = docs.select("doc_id", text_key().alias("key")).join(suffix.strip_repeats(docs, size), "key")
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), r.kept.hex()) for r in out.collect()) == want
    assert suffix.strip_repeats(none, size).count() == 0


def test_blind_trie_sorts():
    r = random.Random(1)
    strings = list({bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(300)})
    order, lcp = suffix.suffix_order(strings, np.zeros(len(strings), np.int64))
    assert [strings[i] for i in order] == sorted(strings)
    assert all(v == suffix.common(strings[a], strings[b]) for a, b, v in zip(order[:-1], order[1:], lcp[1:]))


def test_exact(docs, none):
    rows = [(d, len(t), re.sub(WHITE, "", t)) for d, t in pairs(docs)]
    size = Counter(b for _, _, b in rows)
    best = {b: min((-n, d is None, d) for d, n, x in rows if x == b)[2] if size[b] else None for b in size}
    got = exact.keep_longest(docs, batches=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((d, best[b], size[b], sha(b)) for d, _, b in rows)
    assert sum(r.kept for r in got) == len(size)
    assert exact.keep_longest(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_binary_fuse_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact.BinaryFuse.build(keys)
    assert f.has(keys).all()
    if n > 100:
        others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert f.has(others).mean() < 0.02 and len(f.prints) < 2 * n + 2000


def test_packing(docs, none):
    code, window = encoder(queries.tokenizer()), 64
    ids = {}
    for d, t in pairs(docs):
        ids.setdefault(d, []).append(code.direct(t) + [2])
    got = packing.pack(docs, queries.tokenizer(), window).collect()
    want = Counter((d, a, len(v[a:a + window]), zlib.crc32(np.array(v[a:a + window], "<u4").tobytes()), len(v)) for d, vs in ids.items() for v in vs for a in range(0, len(v), window))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= window
    assert packing.pack(none, queries.tokenizer()).count() == 0


def test_packed_sequences_hold_the_tokens(docs):
    code, window = encoder(queries.tokenizer()), 64
    want = Counter(tuple(v[a:a + window]) for _, t in pairs(docs) for v in [code.direct(t) + [2]] for a in range(0, len(v), window))
    by, got = {}, Counter()
    for r in packing.pack(docs, queries.tokenizer(), window).collect():
        row, ids = by.setdefault(r.sequence_id, [None] * window), np.frombuffer(r.ids, "<u4").tolist()
        assert row[r.offset:r.offset + r.length] == [None] * len(ids)
        row[r.offset:r.offset + r.length] = ids
        got[tuple(ids)] += 1
    assert got == want and all(None not in row[:len(row) - row.count(None)] for row in by.values())


def test_best_fit_decreasing_is_the_plain_one():
    r = random.Random(2)
    for _ in range(150):
        w = r.choice([8, 16, 64, 4096])
        counts = {r.randint(1, w): r.randint(1, 40) for _ in range(6)}
        left, open_ = {}, []
        for length, _, n, first, offset in packing.best_fit(counts, w):
            for i in range(n):
                left[first + i] = max(left.get(first + i, 0), offset + length)
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [x for x in open_ if x >= length]
            open_.append((min(fits) if fits else w) - length)
            if fits:
                open_.remove(min(fits))
        assert sorted(w - x for x in left.values()) == sorted(open_)


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language(spark, "/root/testdata/sf0.01").join(table, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    judged = language.label_documents(docs, table).select("doc_id", "text", "lang_pred", "lang_score").collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.lang_score <= 1 for r in judged)
    assert {r.lang_pred for r in language.label_documents(docs, table.filter("lang is null")).collect()} == {"und"}
    assert language.label_documents(none, table).count() == 0


def test_language_tags_are_values(spark):
    """Tags that differ in case, hold a backtick or are called like a column, against a plain count."""
    said = {"en": "the green house", "EN": "THAT brown horse", "a`b": "ein rotes haus", "w": "la maison bleue", "": "una casa roja"}
    table = spark.createDataFrame([(t, k) for k, t in said.items() for _ in range(4)], "text string, lang string")
    model = language.fit(table)
    assert model.langs == sorted(said) and set(model.words) == {w for t in said.values() for w in t.lower().split()}
    n = {w: np.array([4.0 * (w in said[k].lower().split()) for k in model.langs]) for w in model.words}
    total = sum(n.values())
    assert set(model.grams) == {g for w in model.words for k in range(1, 5) for i in range(len(w) + 3 - k) if (g := f"^{w}$"[i:i + k])}
    for w, row in model.words.items():
        assert np.allclose(model.logs[row], np.log((n[w] + 0.5) / (total + 0.5 * len(n))))
    judged = language.label_documents(table, table).select("lang", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in judged)


def test_urls(spark):
    listed = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    given = ["http://a.example.net/en/x", "http://a.example.net/de", "https://EXAMPLE.net?q", "x://net/", "http://inet/", None, "", "no scheme/net/",
             "http://b.org/fr/?x#y", "http://example.com/de", "http://www.example.com/de/1", "ftp://casino.example.com/", "http://a\nb.net/\n?", "http://org/fr/", "http://net/"]
    rows = [(i, u, u) for i, u in enumerate(given)] + [(None, "http://net/", ""), (0, given[0], None)]
    def want(u):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(n), n, v) for n, v in listed for h, p in [n.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        other = "block" if re.search(r"^([^/]*[.-])?(adserver|doubleclick|casino)[.-]", host + path) else "allow"
        return (host, path, *(max(fits)[1:] if fits else (None, other)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    assert Counter(tuple(r) for r in urls.judge(pages, queries.RULES).collect()) == Counter((i, *want(u)) for i, u, _ in rows)
    assert urls.judge(pages.filter("false"), queries.RULES).count() == 0


def test_warc(spark):
    big = "<p>" + "é\x1f" * 300
    nested = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n", 0).decode("latin-1")
    html = [big, big, None, "", "short", "short", nested + "y" * 100, big, "z" * 5000]
    rows = [(i * 3 % 7 if i < 7 else i, f"http://a/{i} \r\nX: y", h, "r") for i, h in enumerate(html)] + [(None, None, big, "r"), (None, "u", "n" * 200, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h, _ in rows:
        b, lead = (h or "").encode(), first.get(h)
        lead = None if lead == i else lead
        want[(i, len(b), sha(b), "response" if lead is None else "revisit", lead)] += 1
    folder = warc.write_archives(pages)
    for split in (57, 1 << 22):
        out = warc.resolved(warc.read_archives(spark, folder, split))
        assert Counter(tuple(r) for r in out.collect()) == want
    assert warc.resolved(warc.read_archives(spark, warc.write_archives(pages.filter("false")))).count() == 0


def test_warc_is_read_by_several_tasks(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("html"))
    folder = warc.write_archives(pages)
    tasks = [r["n"] for r in warc.read_archives(spark, folder, 4096).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 400 and len(tasks) > 4


def test_forest_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 60)   # several blocks and packs
    monkeypatch.setattr(forest, "QUERIES", 3)
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(200)]
    rows += [rows[0]] * 3 + [(50, rows[7][1]), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for a in forest.search(table, F.col("vec_id") % 50 == 0, trees=256, miss=0.0).collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.vec_id, a.score))
    asked = {(i, tuple(v)) for i, v in rows if i % 50 == 0}
    want: dict = {}
    for i, v in asked:
        best = sorted((-forest.exact_cosine(np.array(v), np.array(x)), j) for j, x in rows if j != i)[:5]
        want.setdefault(i, []).extend((k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert len(got[0]) == 5 and len(got[50]) == 10


def test_forest(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 16)).astype("float32").tolist()
    x[10] = x[20] = x[30] = x[0]
    rows = [(i, v, 1.0) for i, v in enumerate(x)] + [(700, None, 1.0), (701, [0.0] * 16, 1.0), (702, [None] + [1.0] * 15, 1.0), (703, [math.inf] * 16, 1.0), (None, x[1], 1.0), (704, [1.0, 2.0], 1.0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score double")
    got = {}
    for q in forest.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    hits = total = 0
    for i in range(0, 600, 50):
        s = {j: forest.exact_cosine(np.array(x[i]), np.array(x[j])) for j in range(600) if j != i}
        best = sorted(s, key=lambda j: (-s[j], j))[:5]
        hits, total = hits + len(set(best) & {j for j, _ in got[i]}), total + 5
        assert all(abs(s[j] - v) < 1e-12 for j, v in got[i])
    assert hits / total >= 0.9 and [j for j, _ in got[0]][:3] == [10, 20, 30] and 704 not in got
    assert forest.search(table.filter("false"), F.lit(True)).count() == 0


def test_registered_queries_equal_their_sql(spark):
    import check
    con = check.connect("/root/testdata/sf0.001")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        order = sorted(got.columns)
        want = con.execute(f"select {', '.join(order)} from ({sql})").fetchall()
        assert Counter(tuple(r) for r in got.select(order).collect()) == Counter(want), name


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.store(stage(spark, docs, ""))
        assert out.columns == docs.columns
        if name == "language":
            assert out.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
        if name == "near_duplicates":
            assert near.near_components(out).filter("doc_id <> component_id").count() == 0
        docs = out
    assert P.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.count()


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefgé日") for _ in range(6)) for _ in range(n))
    line, twice, near_one, gone = "One line that many of these documents share with others.", say(60), say(90), say(90)
    rows = [(1, twice), (1, twice), (None, say(70)), (3, near_one), (4, near_one + " tail"), (4, say(30)), (5, "12 34"), (5, "12 34"), (6, None), (7, " ")]
    rows += [(None, rows[2][1])] + [(20 + i, f"{say(9)}\n{line}\n{say(9)}") for i in range(7)]
    rows += [(30 + i, f"{say(80)} \ufffd {edge}{gone}{end} \ufffd {say(80)}") for i, (edge, end) in enumerate([("é", "日"), ("è", "旦")])]
    spark.createDataFrame([(d, t, "en", None) for d, t in rows], "doc_id bigint, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "")]
    holders = {}
    for d, t in docs:
        for x in t.split("\n"):
            holders.setdefault(x.lower(), set()).add(-1 if d is None else d)
    drop = lambda d, x: len(x) >= 40 and len(h := holders[x.lower()]) >= 5 and (-1 if d is None else d) < max(h)
    docs = [(d, "\n".join(x for x in t.split("\n") if not drop(d, x))) for d, t in docs]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in docs]
    up = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    docs = [min((docs[i] for i in range(len(docs)) if up[i] == c), key=lambda x: (x[0] is None, x[0] or 0)) for c in sorted(set(up))]
    assert Counter(d for d, _ in docs)[4] == 1 and len(docs) < len(rows) - 6
    data = [t.encode() for _, t in docs]
    count = Counter(b[i:i + 400] for b in data for i in range(len(b) - 399))
    want = Counter()
    for (d, t), b in zip(docs, data):
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            hit[i:i + 400] |= count[b[i:i + 400]] > 1
        ends = np.cumsum([0] + [len(c.encode()) for c in t])
        text = "".join(c for c, x, y in zip(t, ends, ends[1:]) if not hit[x:y].any())
        assert text.count("\ufffd") == t.count("\ufffd") and (d not in (30, 31) or len(text) < len(t))
        ids = encoder(queries.tokenizer()).direct(text) + [2]
        want[(d, 0, np.array(ids, "<u4").tobytes())] += 1
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.start, bytes(x.ids)) for x in got) == want


def test_cuts_touch_nothing_but_halved_characters(spark):
    import corpus_pipeline as P
    both = "x" * 500
    text = ["\ufffdé" + both + "日\ufffd", "\ufffdè" + both + "旦\ufffd"]   # a half that both last letters share repeats too
    assert P.without_spans("aé日b", [(2, 4)]) == "ab" and P.without_spans("é\ufffdb", [(5, 6)]) == "é\ufffd"
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    assert {r.text for r in P.strip_passages(spark, docs, "").collect()} == {"\ufffdé\ufffd", "\ufffdè\ufffd"}
