"""Exact n-gram Jaccard join with a token-group matrix, and the components of its links.

Every document becomes the set of its word shingles (64-bit hashes). Sets are ordered by global
rarity and keep a prefix so long that two sets of the wanted similarity share at least ``need``
prefix tokens. Of two linked sets the smaller has them early: within the first ninth or so of its
tokens (``short``), as the overlap then has to reach a larger share of it. Prefix tokens of one set
alone are dropped; what remains is the matrix.

Similar documents are grouped: each round compares a set with the leader of the posting it shares
most tokens with, and linked sets become one group. Groups that have settled keep their token
union, (token, group), with the sizes of the members that hold the token. A query set's overlap with
a union bounds its overlap with every member, so only groups reaching ``need`` tokens of fitting
sizes are opened, and only members that share as many, early enough, are compared on whole sets. Bit
masks of whole sets and of their unions bound the overlap beyond the prefixes. Equal sets are one
vertex. Pairs inside a group are never listed.

Nulls, empty and white texts have an empty set and link with nothing. Repeated rows and ids are
separate rows; a component is named by its smallest non-null id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traverse import components
from .common import columns_of, small, release, store
from .words import part_of, slices

FREQUENT = 400_000   # tokens whose frequency orders prefixes; any order gives the same links
SKETCH = 16          # tokens of a set that take part in the rounds
LOCAL = 2            # occurrences in a task's stretch that make a token worth reporting
STRETCH = 1 << 21
MASKS = 8            # 64-bit masks that show which hashes a whole set holds; a bound only, full masks bound nothing


def need(n):
    """Prefix tokens that two linked sets share at least, by the smaller set's size."""
    return F.floor(n / 25) + 1 if isinstance(n, Column) else 1 + n // 25


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles, sorted."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = pc.ascii_split_whitespace(low)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    coded = lists.flatten().dictionary_encode()
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = names[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    empty = np.asarray(pc.equal(pc.binary_length(low), 0))

    def mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
        h = np.full(len(columns[0]), salt, np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    span = len(each) - words + 1
    whole = mixed([each[i:i + span] for i in range(words)], words) if span > 0 else np.zeros(0, np.uint64)
    sets = []
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if empty[k]:
            sets.append(whole[:0])
        elif b - a < words:
            sets.append(mixed([each[i:i + 1] for i in range(a, b)], int(b - a)))
        else:
            sets.append(np.unique(whole[a:b - words + 1]))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([whole[:0], *sets]), np.concatenate([[0], np.cumsum(size)])


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts), sorted by token: the commonest of those that any stretch of the corpus repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def told():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often])], ["token", "n"])
        for batch in batches:
            for a, b in slices(batch.column(0)):
                flat, ends = shingles(part_of(batch.column(0), a, b), words)
                for s, e in zip(ends[:-1], ends[1:]):
                    if (sid := _set_id(flat[s:e])) not in seen:   # copies don't make a token common
                        seen.add(sid)
                        held.append(flat[s:e])
                        n += int(e - s)
                if n > STRETCH:
                    yield told()
                    held, n = [], 0
                    seen.clear()
        if held:
            yield told()

    rows = (docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas().sort_values("token"))
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sid, prefix) of each document; a set that the task has seen before has no prefix."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = often.value
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, ends = shingles(part_of(batch.column(1), a, b), words)
                size, sids, prefix = np.diff(ends), [], []
                values = flat.view(np.int64)
                at = np.minimum(np.searchsorted(token, values), max(len(token) - 1, 0))
                rank = np.where(token[at] == values, count[at], 0) if len(token) else np.zeros(len(values), np.int64)
                for s, e in zip(ends[:-1], ends[1:]):
                    n, sid = int(e - s), _set_id(flat[s:e])
                    sids.append(sid)
                    if n == 0 or sid in seen:
                        prefix.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    take = min(n, n - (percent * n + 99) // 100 + need(n))
                    prefix.append(values[s:e][np.argsort(rank[s:e], kind="stable")[:take]])
                yield pa.RecordBatch.from_arrays(
                    [part_of(batch.column(0), a, b), pa.array(size), pa.array(sids, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "n", "sid", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, sid bigint, prefix array<bigint>")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, tokens, masks) of the wanted set ids."""
    def masks(tokens: np.ndarray) -> np.ndarray:
        held = np.zeros(64 * MASKS, bool)
        held[(tokens >> np.uint64(32)) % np.uint64(64 * MASKS)] = True
        return np.packbits(held).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                flat, ends = shingles(part_of(batch.column(0), a, b), words)
                sets = [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_set_id, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()),
                     pa.array(map(masks, sets), pa.list_(pa.int64()))], ["sid", "tokens", "masks"])

    every = docs.select("text").mapInArrow(run, "sid bigint, tokens binary, masks array<bigint>")
    return every.join(small(wanted), "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"), F.first("masks").alias("masks"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose whole sets reach the similarity."""
    @F.arrow_udf("boolean")
    def close(x: pa.Array, y: pa.Array) -> pa.Array:
        def judge(p, q):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= percent * (len(p) + len(q) - both)
        return pa.array([judge(p, q) for p, q in zip(x, y)], pa.bool_())

    a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").filter(close("ta", "tb")).select("a", "b")


def _near_size(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def reaches(both: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of x and y tokens can be linked when at most ``both`` are shared."""
    return both * (100 + percent) >= (x + y) * percent


def absent(held: str, other: str) -> Column:
    """Tokens of a set with masks ``held``0.. that another set or union surely lacks, at least."""
    return sum((F.bit_count(F.col(f"{held}{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}{i}")))) for i in range(MASKS)), F.lit(0))


def _across(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): pairs of different groups that links connect."""
    return (links.join(groups.select(F.col("sid").alias("a"), F.col("grp").alias("src")), "a")
            .join(groups.select(F.col("sid").alias("b"), F.col("grp").alias("dst")), "b").filter("src <> dst").select("src", "dst").distinct())


def _lean(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Each group joins one group that its links reach, two steps up: sound, if not yet complete.
    Links lead to leaders of smaller hash, so steps never come back."""
    up = _across(groups, links).groupBy("src").agg(F.min("dst").alias("dst"))
    over = up.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    up = up.join(over, "dst", "left").select(F.col("src").alias("grp"), F.coalesce("next", "dst").alias("to"))
    return store(groups.join(up, "grp", "left").select("sid", F.coalesce("to", "grp").alias("grp")))


def link_sets(matrix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, grp) for the sets of the matrix (token, sid, n, at, short, rare). ``rare`` counts a set's prefix tokens
    that no other has: the first round's leaders have fewest, as what others were copied from has."""
    groups = store(matrix.select("sid", F.col("sid").alias("grp")).distinct())
    total = groups.count()
    if not total:
        return groups
    # rounds compare sketches, the tokens of least hash of each set: they only choose whom to compare first
    mine = Window.partitionBy("sid").orderBy(F.xxhash64("token"))
    sketch = store(matrix.withColumn("r", F.row_number().over(mine)).filter(F.col("r") <= SKETCH).drop("r"))
    tried, links, turn, fresh = None, None, 0, total
    while fresh * 200 > total:   # rounds pay while they link many; what they leave is settled below
        placed = sketch.join(groups, "sid")
        leader = (placed.groupBy("token").agg(F.min(F.struct((F.col("rare") if turn == 0 else F.lit(0)).alias("c"), F.xxhash64("sid", F.lit(turn)).alias("h"), F.col("sid").alias("b"), F.col("grp").alias("bg"), F.col("n").alias("bn"))).alias("l"),
                                              F.min("grp").alias("g0"), F.max("grp").alias("g1"))
                  .filter("g0 <> g1").select("token", "l.*"))
        votes = (placed.join(leader, "token").filter(F.col("grp") != F.col("bg")).filter(_near_size(F.col("n"), F.col("bn"), percent))
                 .groupBy(F.col("sid").alias("a"), "b").agg(F.count("*").alias("v")))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        pairs = store(votes.groupBy("a").agg(F.max(F.struct("v", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
        found = store(linked(pairs, sets, percent))
        fresh, turn = found.count(), turn + 1
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        if fresh:
            before, groups = groups, _lean(groups, found)
            release(before)
    release(sketch)
    groups = _settle(groups, links)
    # what is left: sets against the token unions of other groups, over tokens that several groups hold
    placed = matrix.join(groups, "sid")
    torn = placed.groupBy("token").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 <> g1").select("token")
    weight = groups.groupBy("grp").agg(F.count("*").alias("w"))
    placed = store(placed.join(torn, "token").join(weight, "grp"))
    release(matrix)
    # a set can be the smaller or the larger of a pair only if enough of these tokens lie early enough in it
    n, left = F.col("n"), F.col("n") - F.col("first")
    roles = placed.groupBy("sid", "n").agg(F.count("*").alias("v"), F.count_if("short").alias("sv"), F.min("at").alias("first")).select(
        "sid", ((F.col("sv") >= need(n)) & reaches(left, n, n, percent)).alias("less"),
        ((F.col("v") >= need(n * percent / 100)) & (left * 100 >= n * percent)).alias("more")).filter("less or more")
    masks = sets.select("sid", *(F.col("masks")[i].alias(f"m{i}") for i in range(MASKS)))
    mine, theirs = ([f"{x}{i}" for i in range(MASKS)] for x in "mu")
    wide, placed = placed, store(placed.join(roles, "sid").withColumn("less", F.col("short") & F.col("less")).drop("short").filter("less or more").join(masks, "sid"))
    release(wide)
    key = lambda w, g: F.struct(F.col(w), F.col(g))  # noqa: E731  the smaller group asks the larger

    def asked(role: str, of: str, least: Column, sizes: Column, smallest: Column, share: Column) -> DataFrame:
        """(sid, g): sets in a role, and the groups whose members in the other one may be linked with them."""
        unions = placed.filter(of).groupBy("token", F.col("grp").alias("g"), F.col("w").alias("gw")).agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("at_low"), F.max("at").alias("at_high"),
            *(F.bit_or(m).alias(u) for m, u in zip(mine, theirs)))
        both = F.least("at", "at_high") + F.least(n - F.col("at"), F.col("high") - F.col("at_low"))
        both = F.least(both, n - absent("m", "u"))
        return (placed.filter(role).select("token", "sid", "n", "at", "grp", "w", *mine).join(unions, "token")
                .filter((key("w", "grp") < key("gw", "g")) & sizes & reaches(both, n, smallest, percent))
                .groupBy("sid", "n", "g").agg(F.count("*").alias("v"), F.min("at").alias("first"))
                .filter((F.col("v") >= least) & share).select("sid", "g", (F.lit(role) == "less").alias("under")))

    bound = store(
        asked("less", "more", need(n), (F.col("high") >= n) & (F.col("low") * percent <= n * 100), F.greatest("low", "n"),
              reaches(left, n, n, percent))
        .union(asked("more", "less", need(n * percent / 100), (F.col("low") < n) & (F.col("high") * 100 >= n * percent),
                     F.greatest(F.col("low"), n * percent / 100), left * 100 >= n * percent)))
    opened = placed.select("token", "sid", "n", "at", "less", "more", *mine).join(bound, "sid").filter(F.when(F.col("under"), F.col("less")).otherwise(F.col("more"))).drop("less", "more")
    members = placed.select("token", F.col("grp").alias("g"), F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bat"), "less", "more", *(F.col(m).alias(u) for m, u in zip(mine, theirs)))
    members = (members.filter("more").withColumn("under", F.lit(True)).union(members.filter("less").withColumn("under", F.lit(False)))
               .drop("less", "more"))
    shared = F.least(F.least("at", "bat") + F.least(n - F.col("at"), F.col("bn") - F.col("bat")),
                     n - absent("m", "u"), F.col("bn") - absent("u", "m"))
    pairs = (opened.join(members, ["token", "g", "under"]).filter(_near_size(F.col("n"), F.col("bn"), percent))
             .filter(F.when(F.col("under"), F.col("bn") >= n).otherwise(F.col("bn") < n) & reaches(shared, n, F.col("bn"), percent))
             .groupBy(F.col("sid").alias("a"), "b", "n", "bn").agg(F.count("*").alias("v"), F.min("at").alias("at"), F.min("bat").alias("bat"))
             .filter(F.col("v") >= need(F.least("n", "bn") * 1.0).cast("bigint"))
             .filter(reaches(F.least(F.col("n") - F.col("at"), F.col("bn") - F.col("bat")), F.col("n"), F.col("bn"), percent)).select("a", "b"))
    both = tried.union(tried.select("b", "a"))
    return _settle(groups, linked(store(pairs.join(both, ["a", "b"], "left_anti")), sets, percent))


def _settle(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, grp) after joining all groups that links connect."""
    ends = store(_across(groups, links))
    if ends.isEmpty():
        return groups
    ends = ends.union(ends.select("dst", "src"))
    up = components(ends, ends.select(F.col("src").alias("id")).distinct())
    return store(groups.join(up.select(F.col("id").alias("grp"), "comp"), "grp", "left").select("sid", F.coalesce("comp", "grp").alias("grp")))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    columns_of(docs, ["doc_id", "text"])
    meta = store(prefixes(docs, words, percent))
    postings = meta.filter("prefix is not null").select("sid", "n", F.posexplode("prefix").alias("at", "token"))
    postings = postings.withColumn("short", F.col("at") < F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + need(F.col("n")))
    shared = postings.groupBy("token").agg(F.min("sid").alias("s0"), F.max("sid").alias("s1")).filter("s0 <> s1").select("token")
    matrix = store(postings.join(shared, "token").select("token", "sid", "n", "at", "short").distinct())
    hopeful = matrix.groupBy("sid", "n").agg(F.count("*").alias("v")).filter(
        F.col("v") >= need(F.col("n") * percent / 100).cast("bigint"))
    length = F.least("n", F.col("n") - F.ceil(F.col("n") * percent / 100) + need(F.col("n")))
    hopeful = store(hopeful.select("sid", (length - F.col("v")).alias("rare")))
    loose, matrix = matrix, store(matrix.join(hopeful, "sid"))
    release(loose)
    sets = store(whole_sets(docs, hopeful.select("sid"), words))
    groups = link_sets(matrix, sets, percent)
    rows = meta.select("doc_id", "n", "sid").join(groups, "sid", "left").withColumn("grp", F.when(F.col("n") > 0, F.coalesce("grp", "sid")))
    named = rows.filter("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("first"))
    return rows.join(named, "grp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
