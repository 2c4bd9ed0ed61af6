"""Structured Streaming versions of the temporal operators.

Sources are file streams over the event table; every job writes its last state per key to a
table and runs with ``availableNow``. Order inside the state is (t, e_id).
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.ranges import rank_in_group, top_k
from ..operators.temporal import both_ends
from ..plans.views import EVENT_TYPES


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """(e_id, src, dst, t, msg, ts) from the events file as it grows."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/events.parquet*")
    code = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    ts = F.col("ts").cast("timestamp")
    return raw.select(F.col("event_id").alias("e_id"), (F.col("user_id") * 2).alias("src"), (code * 2 + 1).cast("bigint").alias("dst"),
                      F.unix_micros(ts).alias("t"), F.col("value").alias("msg"), ts.alias("ts"))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder (a local one only where none is named)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomgraph-stream-")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the input and read back what was written.

    Append writes parquet once per row. Update keeps each batch beside its number, and readers take the
    last one per key; complete returns the last batch, which holds the whole result.
    """
    spark, root = stream.sparkSession, work_dir(stream.sparkSession)
    out = f"{root}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start()
    else:
        def write(df: DataFrame, batch: int) -> None:
            # overwriting the batch's own folder makes a replayed batch harmless
            df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        q = stream.writeStream.foreachBatch(write).option(
            "checkpointLocation", f"{root}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    return got.filter(F.col("batch") == got.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else got


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def tumbling(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """No watermark: an event counts however late it comes."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w, "dst").agg(
        F.count("*").alias("n"), F.sum("msg").alias("total")).select("window.start", "dst", "n", "total")


def run_tumbling(spark: SparkSession, path: str, width: str, slide: str | None = None) -> DataFrame:
    return newest(drain(tumbling(events_stream(spark, path), width, slide), "update"), ["start", "dst"])


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "src").agg(
        F.count("*").alias("n")).select("src", F.col("w.start").alias("start"), "n")


def run_sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    return drain(sessions(events_stream(spark, path), gap), "complete")


def run_degrees(spark: SparkSession, path: str) -> DataFrame:
    return newest(drain(both_ends(events_stream(spark, path)).groupBy("node").agg(F.count("*").alias("n")), "update"), ["node"])


# stateful operators ----------------------------------------------------------------------------------------

def run_last_k(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Latest k neighbours per node in (t, e_id) order.

    The k latest of all rows are among those kept before and those of the new batch. The group limit
    leaves k rows of a node in every task before they meet, so a hub splits over tasks. Each batch
    writes its own state folder, so a replay rewrites the same rows.
    """
    root = work_dir(spark)
    state = "node bigint, other bigint, e_id bigint, t bigint"
    latest = [F.col("t").desc(), F.col("e_id").desc(), F.col("other").desc()]

    def merge(df: DataFrame, batch: int) -> None:
        rows = both_ends(df).select("node", "other", "e_id", "t")
        if batch > 0:
            rows = rows.unionByName(df.sparkSession.read.schema(state).parquet(f"{root}/state/{batch - 1}"))
        top_k(rows, ["node"], latest, k).drop("rank").write.mode("overwrite").parquet(f"{root}/state/{batch}")
        last.append(batch)

    last: list[int] = []
    q = events_stream(spark, path).writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(state).parquet(f"{root}/state/{max(last)}").select("node", "other", "e_id")


def run_memory(spark: SparkSession, path: str, decay: float) -> DataFrame:
    """memory <- decay * memory + msg per event of the node, in (t, e_id) order.

    The fold is linear, so a micro-batch reduces to (events, decayed sum) per node by ranks and
    an aggregate, and merges with the state table of the batch before: memory * decay^events +
    sum. Each batch writes its own state folder, so a replay rewrites the same rows.
    """
    root = work_dir(spark)
    state = "node bigint, memory double, last_t bigint"

    def merge(df: DataFrame, batch: int) -> None:
        ranked = rank_in_group(both_ends(df), ["node"], [F.col("t").desc(), F.col("e_id").desc()], "after")
        new = ranked.groupBy("node").agg(F.sum(F.col("msg") * F.pow(F.lit(decay), F.col("after"))).alias("add"),
                                         F.count("*").alias("n"), F.max("t").alias("new_t"))
        old = (df.sparkSession.read.schema(state).parquet(f"{root}/state/{batch - 1}") if batch > 0
               else df.sparkSession.createDataFrame([], state))
        merged = old.join(new, "node", "full").select(
            "node", (F.coalesce("memory", F.lit(0.0)) * F.pow(F.lit(decay), F.coalesce("n", F.lit(0))) + F.coalesce("add", F.lit(0.0))).alias("memory"),
            F.coalesce("new_t", "last_t").alias("last_t"))
        merged.write.mode("overwrite").parquet(f"{root}/state/{batch}")
        last.append(batch)

    last: list[int] = []
    q = events_stream(spark, path).writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(state).parquet(f"{root}/state/{max(last)}")
