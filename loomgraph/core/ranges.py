"""Order-dependent columns (ranks, ordinals, running sums) without a single-task window.

A plain window over a hot key, or over no key at all, sorts all its rows in one task.
Here rows are range-partitioned by (group, order) so a hot group spreads over many
partitions; each partition ranks its own slice and a small per-partition carry table
(at most one row per group and partition) joins the slices up.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

SLICE = "_slice"


def lay_out(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range-partition by ``keys`` and pin each row's slice number in a column."""
    return cut(df.repartitionByRange(*keys).withColumn(SLICE, F.spark_partition_id()))


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
            sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums ``sums`` within ``groups`` along ``order``.

    ``order`` must be total within a group, so the result does not depend on layout.
    """
    groups = list(groups)
    laid = lay_out(df, [F.col(g) for g in groups] + list(order))
    totals = laid.groupBy(*groups, SLICE).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*groups, SLICE, *[
        F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums])
    inside = Window.partitionBy(*groups, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = laid.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    out = local.join(carry, [*groups, SLICE])
    keep = [c for c in df.columns if c not in sums]
    return out.select(*keep, *[(F.col(k) + F.col(f"_c_{k}")).alias(k) for k in sums])


def rank_in_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                  name: str = "rank") -> DataFrame:
    """Zero-based rank in each group; safe when one group holds most rows."""
    out = running(df, groups, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def global_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Zero-based ordinal over the whole table."""
    return rank_in_group(df, [], order, name)


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows per group, ranked from 0.

    The ``row_number() <= k`` shape lets Catalyst place a group limit before the shuffle,
    so a hot group sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
            .withColumn(name, F.col(name).cast("bigint") - 1))
