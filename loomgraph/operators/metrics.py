"""Classification and ranking metrics as aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import vec
from ..core.ranges import running


def accuracy(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """One row; NULL on empty input."""
    return df.agg(F.avg((F.col(pred) == F.col(target)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, classes: int, pred: str = "pred", target: str = "target",
              by: str | None = None) -> DataFrame:
    """(class, tp, fp, fn, tn): all counts in one aggregation, then one row per class."""
    p, t = F.col(pred), F.col(target)
    keys = [by] if by else []
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *[a for c in range(classes) for a in (
        F.count_if((p == c) & (t == c)).alias(f"tp{c}"),
        F.count_if((p == c) & (t != c)).alias(f"fp{c}"),
        F.count_if((p != c) & (t == c)).alias(f"fn{c}"))])
    rows = counts.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"fp{c}").alias("fp"),
        F.col(f"fn{c}").alias("fn"),
        (F.col("n") - F.col(f"tp{c}") - F.col(f"fp{c}") - F.col(f"fn{c}")).alias("tn"))
        for c in range(classes)])).alias("r"))
    return rows.select(*keys, "r.*")


def _share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return vec.ratio(a.cast("double"), b.cast("double"), empty)


def precision_recall_f1(df: DataFrame, classes: int, pred: str = "pred",
                        target: str = "target") -> DataFrame:
    """Per class; 0/0 counts as 0."""
    c = confusion(df, classes, pred, target)
    p = _share(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("class", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def intersection_and_union(df: DataFrame, classes: int, pred: str = "pred",
                           target: str = "target", by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    return confusion(df, classes, pred, target, by).select(
        *keys, "class", F.col("tp").alias("i"), (F.col("tp") + F.col("fp") + F.col("fn")).alias("u"))


def mean_iou(df: DataFrame, classes: int, pred: str = "pred", target: str = "target",
             by: str | None = None) -> DataFrame:
    """Mean over classes; a class absent from both counts as 1."""
    iu = intersection_and_union(df, classes, pred, target, by)
    return iu.groupBy(*([by] if by else [])).agg(F.avg(_share(F.col("i"), F.col("u"), 1.0)).alias("miou"))


# ranked lists: df(score, label) with label 1 for positives; ties broken by ``tie`` ------------

def _ranked(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    return running(df.select(score, label, tie), [], [F.col(score).desc(), F.col(tie)], {
        "tp": (F.col(label) == 1).cast("bigint"), "fp": (F.col(label) != 1).cast("bigint")})


def best_accuracy(df: DataFrame, score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Best percentage right over every cut of the ranked list (a cut keeps at least one)."""
    ranked = _ranked(df, score, label, tie)
    n_neg = df.agg(F.count_if(F.col(label) != 1).alias("neg"), F.count("*").alias("n"))
    top = ranked.agg(F.max(F.col("tp") - F.col("fp")).alias("gain"))
    return top.crossJoin(n_neg).select(  # two one-row tables
        F.greatest((F.col("gain") + F.col("neg")) * 100.0 / F.col("n"), F.lit(0.0)).alias("best_accuracy"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve with ties as trapezoids.

    Equal scores merge first (map-side), so the running sums see distinct scores only.
    """
    steps = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"),
                                  F.count_if(F.col(label) != 1).alias("q"))
    run = running(steps, [], [F.col(score).desc()], {"tp": F.col("p"), "fp": F.col("q")})
    # steps.p and q survive beside the running sums
    area = run.agg(F.sum((2 * F.col("tp") - F.col("p")) * F.col("q") / 2.0).alias("a"),
                   F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return area.select(_share(F.col("a"), F.col("pos") * F.col("neg")).alias("auc"))


def roc_n(df: DataFrame, max_fp: int, score: str = "score", label: str = "label",
          tie: str = "id") -> DataFrame:
    """As ``roc_auc`` over the ranked list read until ``max_fp`` negatives have been seen.

    Trapezoids are halved in whole numbers, as published.
    """
    ranked = _ranked(df, score, label, tie)
    is_neg = (F.col(label) != 1).cast("bigint")
    read = ranked.filter((F.col("fp") - is_neg) < max_fp)  # negatives seen before this row
    steps = read.groupBy(score).agg(
        F.max("tp").alias("tp"), F.max("fp").alias("fp"),
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    area = steps.agg(F.sum(F.floor((2 * F.col("tp") - F.col("p")) * F.col("q") / 2)).alias("a"),
                     F.max("fp").alias("fp"))
    pos = df.agg(F.count_if(F.col(label) == 1).alias("pos"))
    return area.crossJoin(pos).select(  # two one-row tables
        _share(F.col("a"), F.col("pos") * F.col("fp")).alias("roc_n"))


def median_rfp(df: DataFrame, score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Share of negatives ranked above the median positive."""
    ranked = _ranked(df, score, label, tie)
    size = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    hit = ranked.filter(F.col(label) == 1).crossJoin(F.broadcast(size)).filter(
        F.col("tp") == F.floor((F.col("pos") + 1) / 2))
    return hit.agg(F.min(_share(F.col("fp"), F.col("neg"))).alias("median_rfp"))


def mean_and_std(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
