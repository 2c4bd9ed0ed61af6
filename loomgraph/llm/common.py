"""Helpers shared by the training-data operators: stored steps, text keys, checked broadcasts."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\f\r"
BROADCAST_ROWS = 1_000_000   # rows of a few machine words each; larger sides are joined by shuffle


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names (tests: one of their own)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def store(df: DataFrame) -> DataFrame:
    """Write a step as Parquet to the shared folder and read it again: later steps start from it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.llm_folder = path
    return out


@contextmanager
def noted_steps() -> Iterator[list[str]]:
    """The folders that ``store`` writes inside the block."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def free(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored steps that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(*steps: DataFrame) -> None:
    """Deletes what ``store`` returned; results that were made from it must be stored themselves."""
    for df in steps:
        free(df.sparkSession, [df.llm_folder])


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """16 bytes that name a text; rows of equal text share every result that depends on text alone."""
    return F.unhex(F.md5(F.encode(text_of(name), "UTF-8")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is within ``rows``, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def columns_of(docs: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in docs.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
