"""Exact removal of long repeated byte strings, by suffix sorting of sampled anchors.

Every ``length``-byte window holds one anchor: the ``gram``-byte string of least hash among those in
the window. Equal windows hold equal anchors at equal offsets, so only the surroundings of anchors
that occur twice can repeat. For these, both context sides are suffix-sorted deep-shallow: the first
16 bytes, as two words, by numpy's lexicographic sort (in place of a multikey quicksort, which would
partition in Python; the order is the same), then blind tries for groups that still agree. The two
sorted orders with their common-prefix lengths tell, for each offset, which windows are equal.
Groups of more than ``GROUP`` different contexts are settled by grouping window digests instead, so
no anchor fills a task.

Texts are bytes of UTF-8, null is empty. A text that occurs in two rows repeats as a whole.
Matches never cross documents. Empty tables give empty results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, store, text_key, text_of
from .words import part_of, slices

GROUP = 4000
CHUNK = 1 << 20
LOW = np.uint64(0xFFFFFF)
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in a row, bounds of each text)."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, position, first and last window start) of the anchors of texts laid in a row.
    The anchor of a window is its leftmost ``gram`` bytes of least hash (40 bits of it)."""
    out, span = [], length - gram + 1
    for c in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[c:c + CHUNK + length - 1]
        n = len(part) - length + 1
        with np.errstate(over="ignore"):
            power = np.full(len(part), ODD, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[part] * power, dtype=np.uint64)])
            shrink = np.full(len(part) - gram + 1, BACK, np.uint64)
            shrink[0] = 1
            h = (sums[gram:] - sums[:-gram]) * np.multiply.accumulate(shrink)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
        # least value of every span of positions, from running minima to both ends of blocks
        v = np.full(-(-len(h) // span) * span, ~np.uint64(0), np.uint64)
        v[:len(h)] = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        rows = v.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        spot = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & LOW).astype(np.int64)
        text = np.searchsorted(bounds, np.arange(c, c + n), "right") - 1
        inside = np.arange(c, c + n) + length <= bounds[text + 1]
        starts = np.flatnonzero(inside)
        if not len(starts):
            continue
        own, of = spot[starts], text[starts]
        turn = np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
        first = starts[turn]
        last = np.append(starts[np.flatnonzero(turn)[1:] - 1], starts[-1])
        out.append((of[turn], h[own[turn]], own[turn] + c, first + c, last + c))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64)) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class BlindTrie:
    """Sorts strings that share a long prefix: nodes store only where to look next; each insertion
    descends blindly, compares once with the leaf it finds, and branches where they differ."""

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.root: list | int = 0

    def insert(self, k: int) -> None:
        """A node is [depth, {byte or -1: child}]; a leaf is the number of a string."""
        s, new, node = self.s, self.s[k], self.root
        while isinstance(node, list):
            c = new[node[0]] if node[0] < len(new) else -1
            node = node[1].get(c, next(iter(node[1].values())) if c not in node[1] else None)
        d = common(s[node], new)
        up, node = None, self.root
        while isinstance(node, list) and node[0] < d:
            up, node = node, node[1][new[node[0]] if node[0] < len(new) else -1]
        c = new[d] if d < len(new) else -1
        if isinstance(node, list) and node[0] == d:
            node[1][c] = k
            return
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        old = s[leaf][d] if d < len(s[leaf]) else -1
        branch = [d, {old: node, c: k}]
        if up is None:
            self.root = branch
        else:
            up[1][new[up[0]] if up[0] < len(new) else -1] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node)
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    d = np.flatnonzero(x != y)
    return int(d[0]) if len(d) else n


def suffix_order(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) within groups; -1 where a group begins."""
    words = np.array([(x[:16] + bytes(16))[:16] for x in strings], "S16")
    raw = np.frombuffer(words.tobytes(), np.dtype(">u8")).reshape(-1, 2)   # shallow: two words are two digits
    order = np.lexsort((raw[:, 1], raw[:, 0], group))
    g, k = group[order], raw[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]).any(axis=1)])
    starts = np.append(np.flatnonzero(fresh), len(order))
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a > 1:
            members = order[a:b]
            same: dict[bytes, list[int]] = {}
            for i in members:
                same.setdefault(strings[i], []).append(i)
            texts = list(same)
            trie = BlindTrie(texts)
            for j in range(1, len(texts)):
                trie.insert(j)
            order[a:b] = [i for j in trie.order() for i in same[texts[j]]]
    lcp = np.array([-1] + [common(strings[p], strings[q]) if gp == gq else -1 for p, q, gp, gq in
                           zip(order[:-1], order[1:], group[order[:-1]], group[order[1:]])], np.int64)
    return order, lcp


def repeated_windows(group: np.ndarray, at: np.ndarray, last: np.ndarray, ctx: list[bytes], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For contexts (bytes from their first window start to their last window's end; the anchor lies
    ``at`` bytes in, ``last`` is the last window start): runs of window starts that another context of
    the group repeats at the same distance from the anchor."""
    right, rl = suffix_order([c[a + gram:] for c, a in zip(ctx, at)], group)
    rl = np.where(rl < 0, rl, rl + gram)
    left, ll = suffix_order([c[:a][::-1] for c, a in zip(ctx, at)], group)
    found = [[] for _ in ctx]
    for back in range(int(at.max()) + 1):
        has = (at >= back) & (at - back <= last)   # the window begins ``back`` bytes before the anchor
        if has.sum() < 2:
            continue
        x, y = np.empty(len(ctx), np.int64), np.empty(len(ctx), np.int64)
        x[left] = np.cumsum(ll < back)
        y[right] = np.cumsum(rl < length - back)
        ids = np.flatnonzero(has)
        both = x[ids] * (len(ctx) + 1) + y[ids]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        for i in ids[count[inverse] > 1]:
            s = int(at[i] - back)
            if found[i] and found[i][-1][0] == s + 1:
                found[i][-1] = (s, found[i][-1][1])
            else:
                found[i].append((s, s))
    return found


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies): each text once, laid out by key."""
    return docs.select(text_key().alias("key"), text_of().alias("text")).groupBy("key").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(key, spans): byte ranges [start, end) of each text to remove, joined up and in order."""
    gram = max(1, length // 2)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK):
                data, bounds = bytes_of(part_of(batch.column(1), a, b))
                of, h, at, _, _ = anchors(data, bounds, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of + a)), pa.array(h.view(np.int64)), pa.array(at - bounds[of])], ["key", "fp", "at"])

    # a text with copies is removed whole; its anchors still mark passages in other texts
    marks = store(texts.select("key", "text").mapInArrow(mark, "key binary, fp bigint, at bigint"))
    often = store(marks.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))   # stored, so a hot anchor's join can be split
    hits = marks.join(often, "fp").groupBy("key").agg(F.collect_set("at").alias("ats"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: set[bytes] = set()
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK):
                rows = []
                data, bounds = bytes_of(part_of(batch.column(1), a, b))
                keys = part_of(batch.column(0), a, b).to_pylist()
                ats, ends = part_of(batch.column(2), a, b).flatten(), np.asarray(part_of(batch.column(2), a, b).offsets, dtype=np.int64)
                wanted = np.asarray(ats) + np.repeat(bounds[:-1], np.diff(ends))
                found = anchors(data, bounds, length, gram)
                for k, p, f, l in zip(*(x[np.isin(found[2], wanted)].tolist() for x in (found[0], *found[2:]))):
                    ctx = data[f:l + length].tobytes()
                    fp = xxhash.xxh3_64_intdigest(ctx[p - f:p - f + gram]) - (1 << 63)
                    name = xxhash.xxh3_128_digest(ctx + (p - f).to_bytes(4, "little"))
                    again = name in shown
                    shown.add(name)
                    rows.append((keys[k], fp, name, int(f - bounds[k]), p - f, l - f, None if again else ctx))
                if len(shown) > 200_000:
                    shown.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                        ["key", "fp", "name", "start", "at", "last", "ctx"])

    rows = texts.join(hits, "key").select("key", "text", "ats").mapInArrow(
        surround, "key binary, fp bigint, name binary, start bigint, at int, last int, ctx binary")
    rows = store(rows)
    contexts = rows.groupBy("fp", "name", "at", "last").agg(F.max("ctx").alias("ctx"), F.count("*").alias("n"))
    contexts = store(contexts)
    whole = contexts.filter("n > 1").select("fp", "name", F.array(F.struct(F.lit(0).alias("a"), F.col("last").alias("b"))).alias("runs"))
    width = contexts.groupBy("fp").agg(F.count("*").alias("m"), F.min("n").alias("n0")).filter("m > 1 and n0 = 1")
    width = store(width)
    mixed = contexts.join(width, "fp")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            part = part.explode("all", ignore_index=True)
            one = pd.DataFrame(part["all"].tolist())
            found = repeated_windows(part["fp"].to_numpy(), one["at"].to_numpy(np.int64), one["last"].to_numpy(np.int64), one["ctx"].tolist(), length, gram)
            out = pd.DataFrame({"fp": part["fp"], "name": one["name"], "runs": [[{"a": a, "b": b} for a, b in f] for f in found]})
            yield out[out["runs"].map(len) > 0]

    gathered = mixed.filter(F.col("m") <= GROUP).groupBy("fp").agg(F.collect_list(F.struct("name", "at", "last", "ctx")).alias("all"))
    narrow = gathered.mapInPandas(solve, "fp bigint, name binary, runs array<struct<a:int,b:int>>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(fp, name, s, s - at, hashlib.md5(ctx[s:s + length]).digest())
                    for fp, name, at, last, ctx in zip(*(batch.column(i).to_pylist() for i in range(5))) for s in range(last + 1)]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 50_000]), (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["fp", "name", "s", "off", "w"])

    crowded = mixed.filter(F.col("m") > GROUP).select("fp", "name", "at", "last", "ctx")
    each = crowded.mapInArrow(windows, "fp bigint, name binary, s int, off int, w binary")
    twice = each.groupBy("fp", "off", "w").agg(F.count("*").alias("n")).filter("n > 1").select("fp", "off", "w")
    wide = each.join(twice, ["fp", "off", "w"]).select("fp", "name", F.array(F.struct(F.col("s").alias("a"), F.col("s").alias("b"))).alias("runs"))
    runs = whole.unionByName(narrow).unionByName(wide).select("fp", "name", F.explode("runs").alias("r"))
    spans = (rows.select("key", "fp", "name", "start").join(runs, ["fp", "name"])
             .select("key", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + length).alias("b")).alias("s")))
    gathered = spans.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("s"))
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")
    joined = F.aggregate("s", start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)["b"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(x))))
    return gathered.select("key", joined.alias("spans"))


def strip_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(key, copies, n_bytes, spans, kept): each different text with the bytes that stay.
    Rows of ``docs`` find theirs by ``text_key``."""
    columns_of(docs, ["text"])
    texts = distinct_texts(docs)
    data = F.encode("text", "UTF-8")
    size = F.octet_length("text").cast("bigint")
    spans = F.when((F.col("copies") > 1) & (size >= length), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), size.alias("b")))).otherwise(
        F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    out = texts.join(repeated_spans(texts, length), "key", "left").select("key", "copies", size.alias("n_bytes"), data.alias("data"), spans.alias("spans"))
    from_, to = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.b")), F.concat(F.col("spans.a"), F.array("n_bytes"))
    pieces = F.transform(F.arrays_zip(from_.alias("f"), to.alias("t")), lambda x: F.struct((x["f"] + 1).cast("int").alias("at"), (x["t"] - x["f"]).cast("int").alias("n")))
    kept = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.aggregate(
        pieces, F.lit(b""), lambda acc, x: F.concat(acc, F.substring(F.col("data"), x["at"], x["n"]))))
    return out.withColumn("kept", kept).drop("data")
