"""Hard negatives by exact integer scores on tiles.

Rows are laid by label and cut into blocks, anchors among them into packs; a tile is a pack against a
block, its scores one matrix product of 64-bit integers by Strassen's recursion (operands are padded
with zeros to a power of two per level; sums and products are integers, so scores are exact).

First each pack meets the blocks that hold labels of its own, and a heap per anchor keeps the k best
rows of the same label. Then each pack meets every block, and a heap per anchor and positive keeps the
best rows of other labels inside that positive's window of scores. Heaps merge: a task merges those of
its tiles, and Spark's ranked window (group limit before and after the shuffle) those of the tasks. The
anchors are a stated query set; against it every row is scored, nothing is sampled.

Rows with a null id or label, a null vector, or any null or non-finite component take no part, nor do
rows whose squared length after scaling reaches 2**56: up to there a score and its comparisons fit into
64 bits. Vectors of different length never meet. A row that repeats an anchor's id is neither its
positive nor its negative; repeated anchors are mined each, other repeated rows are candidates each.
Empty tables give empty results; columns other than the three named are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.ranges import rank_in_group
from .common import columns_of, small, store

ROWS, ANCHORS = 4_096, 512
LEAF = 16            # no operand dimension is halved below this
OPEN_PACKS = 32      # heaps of so many packs are held in a task before they are handed on
LENGTH_LIMIT = 2.0 ** 56
BLOCK = "dim int, block bigint, ids binary, labels binary, vectors binary, kind string"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product: seven products of halves in place of eight, odd sides padded with zeros."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) < 2 * LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((2 * h, 2 * j), np.int64)
    p = strassen(a11 + a22, b11 + b22)
    q = strassen(a22, b21 - b11)
    r = strassen(a11 + a12, b22)
    out[:h, :j] = p + q - r + strassen(a12 - a22, b21 + b22)
    s = strassen(a21 + a22, b11)
    t = strassen(a11, b12 - b22)
    out[:h, j:], out[h:, :j] = r + t, q + s
    out[h:, j:] = p - s + t + strassen(a21 - a11, b11 + b12)
    return out[:n, :m]


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` owners; best is highest, then smallest id."""

    def __init__(self, k: int):
        self.k, self.owner = k, np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = (np.concatenate(c) for c in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner = owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        self.owner, self.score, self.id = owner[place < self.k], score[order][place < self.k], ids[order][place < self.k]


def packed(rows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Blocks of ``size`` rows in ``order`` within each ``dim``; vectors in the narrowest integers that hold them."""
    laid = rank_in_group(rows, ["dim"], order, "place").withColumn("block", F.floor(F.col("place") / size))

    def close(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        m = np.array(own["v"].tolist(), np.int64).reshape(len(own), key[0])
        top = int(np.abs(m).max(initial=0))
        kind = next(t for t in ("<i2", "<i4", "<i8") if top <= np.iinfo(t).max)
        return pd.DataFrame([(*key, *(own[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label")), m.astype(kind).tobytes(), kind)],
                            columns=["dim", "block", "ids", "labels", "vectors", "kind"])

    return laid.groupBy("dim", "block").applyInPandas(close, BLOCK)


def read(batch: pa.RecordBatch, at: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a packed side of a tile."""
    ids, labels, raw, kind = (batch[f"{side}_{c}"][at] for c in ("ids", "labels", "vectors", "kind"))
    vectors = np.frombuffer(raw.as_buffer(), kind.as_py()).astype(np.int64)
    n = len(ids.as_buffer()) // 8
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64), vectors.reshape(n, -1)


def tiles(packs: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Joins packs, exploded to the blocks they meet, with the blocks."""
    side = lambda df, s: [F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in ("dim", "meets")]
    asks = packs.select("dim", F.col("meets").alias("b_block"), *side(packs, "a")).repartition(width, "dim", "b_block")
    held = blocks.select("dim", *side(blocks, "b")).repartition(width, "dim", "b_block")
    return asks.hint("merge").join(held, ["dim", "b_block"])


def best_rows(heaps: DataFrame, owner: list[str], k: int) -> DataFrame:
    first = Window.partitionBy(*owner).orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def kept(k: int, offers):
    """mapInArrow function: heaps of the tiles of a task, merged per pack; ``offers`` gives (owner, score, id) of a tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Heaps] = {}

        def rows(key: tuple[int, int], heap: Heaps) -> pa.RecordBatch:
            n = len(heap.owner)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1], np.int64)), pa.array(heap.owner), pa.array(heap.score), pa.array(heap.id)],
                ["dim", "pack", "owner", "score", "vec_id"])

        for batch in batches:
            for at in range(batch.num_rows):
                key = (batch["dim"][at].as_py(), batch["a_block"][at].as_py())
                held.setdefault(key, Heaps(k)).merge(*offers(batch, at))
            while len(held) > OPEN_PACKS:
                key = next(iter(held))
                yield rows(key, held.pop(key))
        for key, heap in held.items():
            yield rows(key, heap)

    return run


HEAP = "dim int, pack bigint, owner bigint, score bigint, vec_id bigint"


def positive_offers(k: int):
    def offers(batch: pa.RecordBatch, at: int):
        (q_ids, q_labels, q), (ids, labels, x) = read(batch, at, "a"), read(batch, at, "b")
        mine = np.flatnonzero(np.isin(labels, q_labels))
        ids, labels = ids[mine], labels[mine]
        none = np.iinfo(np.int64).min
        score = np.where((q_labels[:, None] == labels) & (q_ids[:, None] != ids), strassen(q, np.ascontiguousarray(x[mine].T)), none)
        floor = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)] if score.shape[1] else np.zeros(len(q), np.int64)
        own, near = np.nonzero((score >= floor[:, None]) & (score > none))
        return own, score[own, near], ids[near]

    return offers


def window_offers(k: int, low: int, high: int):
    """Rows of other labels with low * positive <= 100 * score <= high * positive, at most ``k`` for each positive."""
    def offers(batch: pa.RecordBatch, at: int):
        (q_ids, q_labels, q), (ids, labels, x) = read(batch, at, "a"), read(batch, at, "b")
        owner, goal = (np.frombuffer(batch[c][at].as_buffer(), np.int64) for c in ("a_owners", "a_goals"))   # rows of the pack, scores
        score = strassen(q, np.ascontiguousarray(x.T))
        least = np.full(len(q), np.iinfo(np.int64).max)
        most = np.full(len(q), np.iinfo(np.int64).min)
        bottom, top = -(-low * goal // 100), high * goal // 100    # 100 * score >= low * goal, and <= high * goal, in whole scores
        np.minimum.at(least, owner, bottom)
        np.maximum.at(most, owner, top)
        own, near = np.nonzero((score >= least[:, None]) & (score <= most[:, None]) & (q_labels[:, None] != labels) & (q_ids[:, None] != ids))
        s, i = score[own, near], ids[near]
        order = np.lexsort((i, -s, own))
        own, s, i = own[order], s[order], i[order]
        bounds = np.searchsorted(own, np.arange(len(q) + 1))
        out = []
        for w, (a, lo, hi) in enumerate(zip(owner.tolist(), bottom.tolist(), top.tolist())):
            b, e = bounds[a], bounds[a + 1]
            start = b + np.searchsorted(-s[b:e], -hi)
            stop = min(start + k, b + np.searchsorted(-s[b:e], -lo, "right"))
            if stop > start:
                out.append((np.full(stop - start, w), s[start:stop], i[start:stop]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    return offers


def mine(vectors: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label)."""
    columns_of(vectors, ["vec_id", "embedding", "label"])
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * F.lit(scale))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0 ** 40))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("v"), F.col("label").cast("bigint").alias("label"), is_anchor.alias("anchor"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
            .withColumn("v", F.transform("v", lambda c: F.floor(c))).filter(length < LENGTH_LIMIT).withColumn("dim", F.size("v")))
    rows = store(rows)
    order = [F.col("label"), F.col("vec_id"), F.xxhash64("v")]
    blocks = store(packed(rows.drop("anchor"), ROWS, order))
    packs = store(packed(rows.filter("anchor").drop("anchor"), ANCHORS, order))
    dims = {r["dim"]: r["n"] for r in blocks.groupBy("dim").agg(F.count("*").alias("n")).collect()}   # one row per vector length
    if not dims:
        none = "anchor_id bigint, positive_id bigint, positive_rank int, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], none)
    width = sum(dims.values())

    @F.arrow_udf("struct<lo: bigint, hi: bigint>")
    def ends(labels: pa.Array) -> pa.Array:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in labels]
        return pa.StructArray.from_arrays([pa.array([int(x[0]) for x in own], pa.int64()), pa.array([int(x[-1]) for x in own], pa.int64())], ["lo", "hi"])

    # blocks lie in label order, so a label's blocks, and those of a pack's labels, are a run of numbers
    held = blocks.select("dim", "block", ends("labels").alias("e"))
    span = packs.select("dim", F.col("block").alias("pack"), ends("labels").alias("p"))
    meets = (span.join(small(held), "dim").filter((F.col("e.lo") <= F.col("p.hi")) & (F.col("e.hi") >= F.col("p.lo")))
             .groupBy("dim", "pack").agg(F.min("block").alias("from"), F.max("block").alias("to")))
    first = packs.join(meets.withColumnRenamed("pack", "block"), ["dim", "block"]).withColumn("meets", F.explode(F.sequence("from", "to"))).drop("from", "to")
    found = best_rows(tiles(first, blocks, width).mapInArrow(kept(positives, positive_offers(positives)), HEAP), ["dim", "pack", "owner"], positives)
    found = store(found.select("dim", "pack", F.col("owner").cast("int").alias("owner"), "rank", "score", "vec_id"))

    # every pack with its positives, in the order (owner, rank); windows are numbered in that order
    in_order = F.array_sort(F.collect_list(F.struct("owner", "rank", "score", "vec_id")))
    goals = found.groupBy("dim", F.col("pack").alias("block")).agg(in_order.alias("g"))

    @F.arrow_udf("binary")
    def longs(values: pa.Array) -> pa.Array:
        return pa.array([np.array(x, np.int64).tobytes() for x in values.to_pylist()], pa.binary())

    every = F.create_map(*[F.lit(x) for d, n in dims.items() for x in (d, n)])
    asks = (packs.join(goals, ["dim", "block"]).withColumns({"owners": longs(F.transform("g.owner", lambda c: c.cast("bigint"))), "goals": longs("g.score")}).drop("g")
            .withColumn("meets", F.explode(F.sequence(F.lit(0).cast("bigint"), (every[F.col("dim")] - 1).cast("bigint")))))
    hard = best_rows(tiles(asks, blocks, width).mapInArrow(kept(negatives, window_offers(negatives, low, high)), HEAP), ["dim", "pack", "owner"], negatives)
    named = found.withColumn("window", F.row_number().over(Window.partitionBy("dim", "pack").orderBy("owner", "rank")) - 1)

    def named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, pack, ids in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(np.full(len(own), pack, np.int64)),
                                                  pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["dim", "pack", "owner", "anchor_id"])

    names = packs.select("dim", "block", "ids").mapInArrow(named_rows, "dim int, pack bigint, owner int, anchor_id bigint")
    who = named.join(names, ["dim", "pack", "owner"]).select(
        "dim", "pack", "window", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score"))
    return hard.withColumnRenamed("owner", "window").join(who, ["dim", "pack", "window"]).select(
        "anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
