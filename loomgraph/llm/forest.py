"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives a vector a long string of sign bits of random projections and keeps the strings
sorted. A query descends in every tree to the longest prefix it shares with any row, then all trees
ascend together, one level at a time, taking in the rows that share the shorter prefix, until a
vector as near as the k-th found so far would have been missed with probability ``miss`` at most.
Every row is indexed and nothing is sampled; scores are exact cosines in double precision.

Rows are laid in blocks by a hash of their id, queries in blocks of their own, and each pair of
blocks is one bounded task with a forest over its rows.

Vectors that are null, zero, or hold nulls or non-finite numbers, and rows without id, take no part;
vectors of different length never meet. Equal scores go to the smaller id. A row that repeats the
query's id is not its neighbour; other repeated rows are candidates each. Query rows that are equal
are asked once and give one answer; query rows of one id with different vectors give one answer each.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of

BITS = 24
ROWS, QUERIES = 4_096, 512


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, rows) strings of BITS sign bits as integers, first bit highest."""
    draw = np.random.default_rng([seed, x.shape[1]])
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([((x @ draw.standard_normal((x.shape[1], BITS))) > 0) @ weight for _ in range(trees)])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Order of the terms plays no part, so equal vectors score equally."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def nearest_in_block(q: np.ndarray, q_ids: np.ndarray, q_copies: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, trees: int, miss: float, seed: int):
    """(query id, its copy, id, score) of the k best candidates of each query in this block."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = q / np.linalg.norm(q, axis=1, keepdims=True)
    keys, wanted = hash_strings(unit, trees, seed), hash_strings(ask, trees, seed)
    order = np.argsort(keys, axis=1, kind="stable")
    keys = np.take_along_axis(keys, order, axis=1)
    low, high = np.empty((BITS + 1, trees, len(q)), np.int32), np.empty((BITS + 1, trees, len(q)), np.int32)
    for t in range(trees):
        for level in range(BITS + 1):
            prefix = wanted[t] >> (BITS - level) << (BITS - level)
            low[level, t] = np.searchsorted(keys[t], prefix, "left")
            high[level, t] = np.searchsorted(keys[t], prefix + (1 << (BITS - level)), "left")
    out = []
    for j in range(len(q)):
        level = max((v for v in range(BITS + 1) if (high[v, :, j] > low[v, :, j]).any()), default=0)
        seen, best, score = np.zeros(len(ids), bool), np.zeros(0, np.int64), np.zeros(0)
        seen[ids == q_ids[j]] = True
        while True:
            near = np.concatenate([order[t, low[level, t, j]:high[level, t, j]] for t in range(trees)])
            fresh = np.unique(near)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            best, score = np.concatenate([best, fresh]), np.concatenate([score, unit[fresh] @ ask[j]])
            if len(best) > k:
                floor = np.partition(score, len(score) - k)[len(score) - k] - 1e-9
                best, score = best[score >= floor], score[score >= floor]
            if level == 0:
                break
            if len(best) >= k:
                agree = 1 - math.acos(min(1.0, max(-1.0, np.partition(score, len(score) - k)[len(score) - k]))) / math.pi
                if (1 - agree ** level) ** trees <= miss:
                    break
            level -= 1
        found = sorted((-exact_cosine(q[j], x[i]), ids[i]) for i in best)[:k]
        out.extend((q_ids[j], q_copies[j], i, -s) for s, i in found)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 64, miss: float = 0.03, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, embedding) where ``is_query`` holds."""
    columns_of(vectors, ["vec_id", "embedding"])
    wide = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("v"), is_query.alias("q")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(sound).withColumn("dim", F.size("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, packs = max(1, -(-n["n"] // ROWS)), max(1, -(-(n["q"] or 0) // QUERIES))
    turn = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    copies = Window.partitionBy("vec_id").orderBy("v")   # small: equal query rows are one by now
    queries = rows.filter("q").select("vec_id", "v", "dim").distinct().withColumn("copy", F.row_number().over(copies))
    points = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), turn(packs).alias("pack"))
    asks = queries.select("vec_id", "copy", "v", "dim", turn(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(packs)).cast("int").alias("pack"))

    def meet(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = [] if not len(ask) or not len(own) else nearest_in_block(
            np.vstack(ask["v"].to_numpy()), ask["vec_id"].to_numpy(), ask["copy"].to_numpy(), np.vstack(own["v"].to_numpy()), own["vec_id"].to_numpy(), k, trees, miss, seed)
        return pd.DataFrame(rows, columns=["query_id", "copy", "vec_id", "score"])

    keys = ["dim", "block", "pack"]
    found = asks.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(meet, "query_id bigint, copy int, vec_id bigint, score double")
    first = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
