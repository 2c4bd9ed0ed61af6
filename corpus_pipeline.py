"""From raw documents to packed training sequences: each stage writes Parquet that the next one reads.

All stages but the last return the columns of ``documents``. The language stage drops documents without
any letter (``und``); the line stage rewrites text; the near-duplicate stage keeps the smallest id of each
component; the suffix stage deletes bytes that repeat (characters that a cut halves are dropped with
it, nothing else is); packing returns pieces with their ids, placed in sequences.

A stage deletes the stored steps of the stage before it, whose result is Parquet by then: of one thread, a
stage's result has to be written before the next one, of whichever run, is asked for.

Documents are told apart by id and text. Of a component the row with the smallest id stays, rows without
id last, ties by a hash of the text; of rows that repeat both id and text one stays, which one is open where
other columns differ. Rows of one id with texts of different components are different documents. Documents
without words are in no component and all stay. Other nulls and empty rows behave as the operators say.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps
from threading import get_ident

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, lines, near, packing, suffix
from loomgraph.llm.common import free, noted_steps, store, text_key, text_of
from loomgraph.llm.queries import tokenizer


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[tuple[str, int], list[str]] = {}   # steps of the last stage, by application and thread


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        me = (spark.sparkContext.applicationId, get_ident())
        free(spark, _left.pop(me, []))
        with noted_steps() as paths:
            out = f(spark, docs, sf_dir)
        _left[me] = paths
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the model knows; learned on the labelled documents themselves."""
    judged = language.label_documents(docs, docs.select("text", "lang"))
    return judged.filter(F.col("lang_pred") != "und").select(*docs.columns)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs).select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; documents without words stay."""
    # equal texts share a component, so texts are what is linked; 64 bits name them, as they name sets in ``near``
    keyed = docs.withColumn("__llm_text", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    found = near.near_components(keyed.select(F.col("__llm_text").alias("doc_id"), "text")).filter("n_shingles > 0")
    links = found.select(F.col("doc_id").alias("__llm_text"), "component_id").distinct()
    first = keyed.filter(worded).groupBy("__llm_text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("f"))
    keep = (first.join(links, "__llm_text").groupBy("component_id").agg(F.min(F.struct("f", "__llm_text")).alias("k"))
            .select(F.col("k.f.doc_id").alias("__llm_id"), F.col("k.__llm_text").alias("__llm_kept")))
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_text") == F.col("__llm_kept"))
    stay = keyed.filter(worded).join(keep, same, "left_semi").dropDuplicates(["doc_id", "__llm_text"])
    return stay.unionByName(keyed.filter(~worded)).select(*docs.columns)


def without_spans(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """``text`` without the byte ranges ``spans``, each widened to whole characters."""
    data, at, out = text.encode(), 0, []
    for a, b in spans:
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        out.append(data[at:max(a, at)])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


@stage
def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def stripped(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else without_spans(t.as_py(), ((x["a"], x["b"]) for x in s))
                         for t, s in zip(text, spans.to_pylist())], pa.string())

    cuts = suffix.strip_repeats(docs.select("text")).filter(F.size("spans") > 0).select(F.col("key").alias("__llm_key"), F.col("spans").alias("__llm_spans"))
    out = docs.withColumn("__llm_key", text_key()).join(cuts, "__llm_key", "left")
    cut = stripped(F.when(F.col("__llm_spans").isNotNull(), text_of()), "__llm_spans")
    return out.withColumn("text", F.coalesce(cut, "text")).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", strip_passages),
    ("packing", pack_sequences),
]
ORACLE_SQL = None   # models, tokenizers and byte windows are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        before, docs = docs, store(step(spark, docs, sf_dir))
        if hasattr(before, "llm_folder"):
            free(spark, [before.llm_folder])
    return STAGES[-1][1](spark, docs, sf_dir)
