"""Timestamped interaction tables: events(e_id, src, dst, t, msg)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.ranges import global_index, top_k
from ..core.session import cut


def event_counts(events: DataFrame) -> DataFrame:
    """One row: number of nodes (max id + 1) and events."""
    return events.agg((F.max(F.greatest("src", "dst")) + 1).alias("num_nodes"), F.count("*").alias("num_events"))


def time_split(events: DataFrame, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Tag events train/val/test by linear-interpolated time quantiles; each cut lies one event
    past the last event at or before its quantile, as published."""
    ordered = cut(global_index(events, [F.col("t"), F.col("e_id")], "pos"))
    q = ordered.agg(F.percentile("t", F.array(F.lit(1 - val - test), F.lit(1 - test))).alias("q"))  # one row
    cuts = ordered.crossJoin(F.broadcast(q)).agg(
        (F.count_if(F.col("t") <= F.col("q")[0]) + 1).alias("_v"), (F.count_if(F.col("t") <= F.col("q")[1]) + 1).alias("_w"))
    return ordered.crossJoin(F.broadcast(cuts)).withColumn("split", F.when(F.col("pos") < F.col("_v"), "train").when(
        F.col("pos") < F.col("_w"), "val").otherwise("test")).drop("_v", "_w")


def sequential_batches(events: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` consecutive events in (t, e_id) order."""
    out = global_index(events, [F.col("t"), F.col("e_id")], "pos")
    return out.withColumn("batch", F.floor(F.col("pos") / size))


def batch_ids(nodes: DataFrame, size: int, group: str = "graph_id", seed: int | None = None) -> DataFrame:
    """(graph_id, batch): graphs in mini-batches of ``size``, in id order or a drawn one."""
    from ..core import mix
    g = nodes.select(group).distinct()
    order = [F.col(group)] if seed is None else [mix.mix(group, seed=seed), F.col(group)]
    return global_index(g, order, "_p").select(group, F.floor(F.col("_p") / size).alias("batch"))


def both_ends(events: DataFrame) -> DataFrame:
    """Each event seen from both of its nodes: (node, other, e_id, t, msg)."""
    return events.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("n"), "e_id", "t", "msg").select(
        "n.*", "e_id", "t", "msg")


def last_neighbors(events: DataFrame, k: int) -> DataFrame:
    """(node, other, e_id): the k latest events of every node."""
    return top_k(both_ends(events), ["node"], [F.col("e_id").desc()], k, "_r").select("node", "other", "e_id")


def identity_message(z_src: Column, z_dst: Column, raw: Column, t_enc: Column) -> Column:
    """Concatenated message."""
    return F.concat(z_src, z_dst, raw, t_enc)


def last_message(events: DataFrame) -> DataFrame:
    """(node, t, msg): each node's latest message (ties by e_id)."""
    return both_ends(events).groupBy("node").agg(F.max_by(F.struct("t", "msg"), F.struct("t", "e_id")).alias("m")).select("node", "m.*")


def mean_message(events: DataFrame) -> DataFrame:
    return both_ends(events).groupBy("node").agg(F.avg("msg").alias("msg"))


def memory_after_batches(events: DataFrame, size: int, decay: float) -> DataFrame:
    """(node, memory, last_t): batch-wise memory; each batch a node takes part in multiplies
    its memory by ``decay`` and adds that batch's latest message.

    The recurrence unrolls to a weighted sum: a message counts decay^(batches of this node
    after it), so ranks within nodes replace the sequential loop.
    """
    from ..core.ranges import rank_in_group
    b = sequential_batches(events, size).select("src", "dst", "e_id", "t", "msg", "batch")
    per = b.select(F.explode(F.array("src", "dst")).alias("node"), "batch", "t", "e_id", "msg").groupBy("node", "batch").agg(
        F.max_by(F.struct("t", "msg"), F.struct("t", "e_id")).alias("m"))
    ranked = rank_in_group(per, ["node"], [F.col("batch").desc()], "after")
    return ranked.groupBy("node").agg(F.sum(F.col("m.msg") * F.pow(F.lit(decay), F.col("after"))).alias("memory"),
                                      F.max("m.t").alias("last_t"))


def time_window_graphs(events: DataFrame, step: int, window: int) -> DataFrame:
    """(graph_id, src, dst, ...): sliding windows of ``window`` buckets of ``step`` time units;
    graph i holds buckets (i - window, i]."""
    first = events.agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))  # one row
    b = events.crossJoin(F.broadcast(first)).withColumn("bucket", F.floor((F.col("t") - F.col("_t0")) / step))
    last = F.floor((F.col("_t1") - F.col("_t0")) / step)
    return b.select("*", F.explode(F.sequence(F.col("bucket"), F.least(F.col("bucket") + window - 1, last))).alias("graph_id")).drop("_t0", "_t1")


def relation_history(events: DataFrame, seq_len: int) -> DataFrame:
    """(e_id, lag, other): objects met by the event's (src, rel) in each of the ``seq_len``
    preceding time steps; events(e_id, src, rel, dst, step). An interval join turned equi-join
    by spelling out the lags."""
    past = events.select("src", "rel", (F.col("step")).alias("_s"), F.col("dst").alias("other")).distinct()
    asked = events.select("e_id", "src", "rel", "step", F.explode(F.sequence(F.lit(1), F.lit(seq_len))).alias("lag")).withColumn(
        "_s", F.col("step") - F.col("lag"))
    return asked.join(past, ["src", "rel", "_s"]).select("e_id", "lag", "other")
