"""Best-fit decreasing packing of token sequences.

A document's ids are cut into full windows and a rest. Pieces of one length are alike, so the
placement works on the histogram of lengths, which has ``window`` entries at most whatever the
corpus: a segment tree over remaining capacities finds the tightest open windows for each length,
largest first, and fills them in runs. Pieces then find their place by length and rank; ranks are
counted over range-laid rows, so a length that many share is no hot spot.

Null text is empty and packs its end id alone; repeated rows pack separately; tables without rows
give none. Sequences are numbered from 0 in opening order.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.ranges import rank_in_group
from .common import columns_of, store
from .words import encoder, part_of, slices


class CapacityTree:
    """Open windows by remaining capacity; a node knows whether any capacity below it is open."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.at: dict[int, deque[list[int]]] = {}

    def _mark(self, r: int, on: int) -> None:
        i = r + self.leaves
        self.open[i] = on
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def put(self, r: int, first: int, count: int) -> None:
        if r > 0:
            self.at.setdefault(r, deque()).append([first, count])
            self._mark(r, 1)

    def tightest(self, need: int) -> int | None:
        """Least open capacity of ``need`` or more."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1 and not (i % 2 == 0 and self.open[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, r: int, most: int) -> tuple[int, int]:
        run = self.at[r][0]
        first, n = run[0], min(run[1], most)
        if n == run[1]:
            self.at[r].popleft()
            if not self.at[r]:
                self._mark(r, 0)
        else:
            run[0], run[1] = run[0] + n, run[1] - n
        return first, n


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank of the first piece, pieces, first sequence, offset) for a histogram."""
    tree, runs, opened = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            room = window if r is None else r
            deep = min(room // length, left)   # a window stays the tightest until these fill it
            if r is None:
                first, n = opened, left // deep
                opened += n
            else:
                first, n = tree.take(r, left // deep)
            for layer in range(deep):
                runs.append((length, rank + layer * n, n, first, window - room + layer * length))
            tree.put(room - deep * length, first, n)
            rank, left = rank + deep * n, left - deep * n
    return runs


def pieces(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): full windows and rests; ids as unsigned 32-bit little-endian bytes."""
    columns_of(docs, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, ends = code.encode(part_of(batch.column(1), a, b))
                where, start, size, ids, total = [], [], [], [], []
                for k, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
                    own = np.append(flat[s:e], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), window):
                        cut = own[at:at + window]
                        where.append(a + k)
                        start.append(at)
                        size.append(len(cut))
                        ids.append(cut.tobytes())
                        total.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint")


def place(cut: DataFrame, window: int = 4096) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; full windows are sequences of their own."""
    spark = cut.sparkSession
    ranked = store(rank_in_group(cut, ["length"], [F.col("doc_id"), F.col("start")], "__llm_rank"))
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most ``window`` rows
    runs = best_fit(counts, window)
    if not runs:
        return ranked.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).drop("__llm_rank")
    by: dict[int, list] = {}
    for length, rank, n, first, offset in runs:
        by.setdefault(length, []).append((rank, first, offset))
    held = spark.sparkContext.broadcast({k: tuple(np.array(c) for c in zip(*v)) for k, v in by.items()})

    @F.arrow_udf("struct<s: bigint, o: bigint>")
    def found(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, at = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in np.unique(size):
            mine = np.flatnonzero(size == k)
            ranks, first, offset = held.value[int(k)]
            i = np.searchsorted(ranks, at[mine], "right") - 1
            seq[mine], off[mine] = first[i] + at[mine] - ranks[i], offset[i]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["s", "o"])

    return (ranked.withColumn("__llm_at", found("length", "__llm_rank"))
            .withColumns({"sequence_id": F.col("__llm_at.s"), "offset": F.col("__llm_at.o")}).drop("__llm_at", "__llm_rank"))


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): every piece with its ids and
    its place. Pieces are stored once under a number of their own; only numbers and lengths are ranked, and
    the places are joined back."""
    cut = store(pieces(docs, path, window, end_id).withColumn("__llm_piece", F.monotonically_increasing_id()))
    places = place(cut.drop("ids", "doc_tokens"), window).select("__llm_piece", "sequence_id", "offset")
    return cut.join(places.hint("shuffle_hash"), "__llm_piece").select(   # one plan at every size: places are never broadcast
        "doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
