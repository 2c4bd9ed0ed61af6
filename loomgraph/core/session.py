"""Session helpers: a tuned local/cluster session and reliable lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # a query's shuffle files go when it ends


def local_session(cores: int = 8, name: str = "loomgraph") -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgraph-ckpt-"))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under the one that checkpoints go to."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later steps neither replay nor re-plan it.

    A checkpoint keeps the size estimate of the plan it replaces, and a join's is the product of its
    sides'. In a loop that joins each round's table with others made from it the estimate is squared
    every round, until its digits alone take minutes; one beyond 64 bits is dropped here.

    The files of the shuffles behind the table are deleted as soon as it is written: nothing reads them
    again, and Spark itself would keep them until the driver collects its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLES, None)
    spark.conf.set(SHUFFLES, "true")
    try:
        out = df.select("*").checkpoint(eager=True)   # a query of its own, so that other readers of df shuffle for themselves
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES)
        else:
            spark.conf.set(SHUFFLES, before)
    done = out._jdf.queryExecution()
    if done.optimizedPlan().stats().sizeInBytes() < 1 << 62:
        return out
    bare = DataFrame(spark._jsparkSession.internalCreateDataFrame(done.toRdd(), out._jdf.schema(), False), spark)
    bare._files = out   # its own RDD has no checkpoint
    return bare


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    rdd = getattr(df, "_files", df)._jdf.queryExecution().analyzed().rdd()
    kept = rdd.getCheckpointFile()
    if kept.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
