"""Exact deduplication against immutable snapshots that are screened by binary-fuse filters.

A snapshot is a stored table of distinct normalised texts, in buckets of their digests, with one
static binary-fuse filter (8-bit prints, three slots a key) per bucket. An incoming batch first
groups its own duplicates; the digests that remain are screened bucket by bucket. What the filter
rejects is new. What it lets through joins the exact bucket and is compared there byte by byte.
New texts become the next snapshot.

A text is normalised by deleting white space; null counts as empty. Of equal texts the row with the
most code points in the original, then the smallest id (null ids last) stays. Repeated rows count
separately. Only ``doc_id`` and ``text`` are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, columns_of, small, store, text_of

BUCKET = 20_000   # digests a bucket aims at


def _spread(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """Static membership filter: no false negatives, about one false positive in 256."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in neighbouring segments, and the print, of each hash."""
        start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        parts = [h & mask, (h >> np.uint64(16)) & mask, (h >> np.uint64(24) ^ h >> np.uint64(5)) & mask]
        at = np.stack([(start + np.uint64(i)) * np.uint64(segment) + p for i, p in enumerate(parts)]).astype(np.int64)
        return at, ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = max(len(keys), 1)
        segment = 1 << min(15, max(2, int(np.log(n) / np.log(3.33) + 2.25)))
        scale = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        segments = max(1, -(-int(n * scale) // segment))
        for seed in range(1, 1000):
            made = cls._peel(_spread(keys, seed), segment, segments)
            if made is not None:
                return cls(seed, segment, segments, made)
            segments += 1 if seed % 8 == 0 else 0
        raise ValueError("no seed peels these keys")

    @classmethod
    def _peel(cls, h: np.ndarray, segment: int, segments: int) -> np.ndarray | None:
        at, prints = cls.slots(h, segment, segments)
        size, n = (segments + 2) * segment, len(h)
        count = np.bincount(at.ravel(), minlength=size)
        owners = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owners, row, np.arange(n))
        rounds, left, ready = [], n, np.flatnonzero(count == 1)
        while len(ready):
            key, first = np.unique(owners[ready], return_index=True)
            slot = ready[first]
            rounds.append((key, slot))
            left -= len(key)
            for row in at:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(owners, row[key], key)
            near = np.unique(at[:, key])
            ready = near[count[near] == 1]
        if left:
            return None
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            a, b, c = at[:, key]
            table[slot] = 0
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
        return table

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self.slots(_spread(keys, self.seed), self.segment, self.segments)
        return prints == self.prints[a] ^ self.prints[b] ^ self.prints[c]


def filters(snapshot: DataFrame) -> DataFrame:
    """(bucket, seed, segment, segments, prints), one row per bucket of (bucket, probe)."""
    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(part["probe"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return snapshot.select("bucket", "probe").groupBy("bucket").applyInPandas(
        build, "bucket bigint, seed bigint, segment bigint, segments bigint, prints binary")


def screened(batch: DataFrame, screen: DataFrame) -> DataFrame:
    """(digest, size) of the batch's digests that a filter lets through."""
    def probe(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(own):
            return part.iloc[:0][["digest", "size"]]
        f = own.iloc[0]
        f = BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint8))
        return part[f.has(part["probe"].to_numpy(np.int64).view(np.uint64))][["digest", "size"]]

    return (batch.select("bucket", "probe", "digest", "size").groupBy("bucket").cogroup(screen.groupBy("bucket"))
            .applyInPandas(probe, "digest binary, size bigint"))


def keep_longest(docs: DataFrame, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    columns_of(docs, ["doc_id", "text"])
    bare = F.translate(text_of(), WHITE, "")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length(text_of()).alias("chars"), F.octet_length(bare).cast("bigint").alias("size"),
        F.unhex(F.sha2(bare, 256)).alias("digest"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()))
    probe = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    # duplicates inside a batch are grouped on their own, before anything is screened
    own = store(rows.groupBy("batch", "digest", "size").agg(F.count("*").alias("n")).withColumn("probe", probe))
    buckets = max(1, -(-own.count() // BUCKET))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), bare.alias("bare")).withColumn(
        "digest", F.unhex(F.sha2("bare", 256)))
    snapshots: list[DataFrame] = []
    homes: list[DataFrame] = []
    for b in range(batches):
        batch = own.filter(F.col("batch") == b)
        for of, snapshot in enumerate(snapshots):
            found = screened(batch, store(filters(snapshot))).join(snapshot.select("digest", "size"), ["digest", "size"])
            same = store(byte_equal(texts.filter(F.col("batch") == b), texts.filter(F.col("batch") == of), found.select("digest")))
            homes.append(same.select(F.lit(b).alias("batch"), "digest", F.lit(of).alias("home")))
            batch = batch.join(same, "digest", "left_anti")
        snapshots.append(store(batch.sortWithinPartitions("bucket", "digest")))
        homes.append(snapshots[-1].select(F.lit(b).alias("batch"), "digest", F.lit(b).alias("home")))
    placed = store(rows.join(reduce(DataFrame.union, homes), ["batch", "digest"]))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = placed.groupBy("digest", "home").agg(F.count("*").alias("group_size"), best.alias("best"))
    return placed.join(groups, ["digest", "home"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def byte_equal(here: DataFrame, there: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest) of those whose texts on both sides are the same bytes."""
    digests = store(digests.distinct())

    def ends(side: DataFrame, low: str, high: str) -> DataFrame:
        return side.join(small(digests), "digest", "left_semi").groupBy("digest").agg(F.min("bare").alias(low), F.max("bare").alias(high))
    return ends(here, "a", "b").join(ends(there, "c", "d"), "digest").filter("a = b and b = c and c = d").select("digest")
