"""Line deduplication over levelled sorted runs of line hashes.

A run holds (key, documents, largest id) sorted by key. Batches come in falling id order. Each new
batch anti-joins the runs on the keys that are settled already (found in enough documents, with a
larger id on record), adds what is left as a run of its own, and a level that has filled up is
merged into one run of the next level.

Null ids count as one document below all others, repeated ids as one document. Null or empty text
is one empty line. Only line keys of ``least_chars`` code points or more are judged, so short lines
always stay. Other columns pass through; one
named like an added column gives way to it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, columns_of, store, text_of

NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _merged(runs: list[DataFrame]) -> DataFrame:
    return (reduce(DataFrame.unionByName, runs).groupBy("key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top")))


class Runs:
    """The levels; ``add`` takes a batch of (key, n_docs, top)."""

    def __init__(self, least_docs: int, fanout: int):
        self.least_docs, self.fanout = least_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        return _merged(self.all()).filter(F.col("n_docs") >= self.least_docs)

    def add(self, batch: DataFrame) -> None:
        if self.all():
            done = self.settled().select("key", F.col("top").alias("_top"))
            batch = batch.join(done, (batch["key"] == done["key"]) & (done["_top"] >= batch["top"]), "left_anti")
        self.levels[0].append(store(batch.sortWithinPartitions("key")))
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(store(_merged(level).sortWithinPartitions("key")))
                self.levels[i] = []


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, ``n_lines`` (before) and ``n_dropped``."""
    columns_of(docs, ["doc_id", "text"])
    row = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of())))
    lines = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("k")))
    kept = store(
        docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), lines.alias("lines"))
        .select("row", "id", F.explode("lines").alias("l"))   # apart: the digest of a text is taken once, not once a line
        .filter(F.length("l.k") >= least_chars)
        .select("row", "id", F.col("l.at").alias("at"), F.unhex(F.md5("l.k")).alias("key")))
    bounds = kept.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("b")).first()["b"] if batches > 1 else []
    cuts = sorted(set(bounds or []), reverse=True)
    runs = Runs(least_docs, fanout)
    for top, low in zip([None, *cuts], [*cuts, None]):
        part = kept if top is None else kept.filter(F.col("id") < top)
        part = part if low is None else part.filter(F.col("id") >= low)
        runs.add(part.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("top")))
    drops = (kept.join(store(runs.settled().select("key", "top")), "key").filter("id < top")
             .groupBy("row").agg(F.collect_set("at").alias("__llm_at")))
    # the lines are an array before the join, so each document is split once and its rest is one pass over positions
    out = (docs.withColumns({"__llm_row": row, "__llm_lines": F.split(text_of(), "\n"), "__llm_null": F.col("text").isNull()}).drop("text")
           .join(drops.withColumnRenamed("row", "__llm_row"), "__llm_row", "left"))
    lines, at = F.col("__llm_lines"), F.col("__llm_at")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: lines[i])
    out = out.withColumns({
        "n_lines": F.size(lines).cast("bigint"),
        "n_dropped": F.coalesce(F.size(at), F.lit(0)).cast("bigint"),
        "text": F.when(at.isNotNull(), F.array_join(rest, "\n")).when(~F.col("__llm_null"), F.array_join(lines, "\n")),
    })
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
