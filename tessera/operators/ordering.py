"""Global order, ranks and exact quantiles without a single-task sort.

A window over one big group would sort that group in one task. Here the rows are range-partitioned
by (group, order), summed within each partition, and shifted by the totals of the earlier
partitions; only one number per (group, partition) is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut


def running_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Add ``before`` (weight of the earlier rows of the group) and ``group_total``."""
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    # The partition number must not change when a task is retried, hence the cut.
    ranged = cut(
        df.withColumn("_w", amount)
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    in_order = Window.partitionBy(*group).orderBy("_part")
    offsets = (
        ranged.groupBy(*group, "_part")
        .agg(F.sum("_w").alias("_sum"))
        .select(
            *group,
            "_part",
            F.coalesce(
                F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_sum").over(Window.partitionBy(*group)).alias("group_total"),
        )
    )
    within = (
        Window.partitionBy(*group, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .join(offsets, [*group, "_part"])
        .withColumn("before", F.col("_inner") + F.col("_offset"))
        .drop("_inner", "_offset", "_part", "_w")
    )


def usable(value: Column) -> Column:
    """NaN as null: statistics skip both."""
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    times: int = 1,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles, named by ``probabilities``.

    Equal values are counted before anything is sorted; every row counts ``times`` times.
    """
    counts = (
        df.select(*group, usable(F.col(value)).alias(value))
        .filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg((F.count(F.lit(1)) * times).alias("_n"))
    )
    placed = running_positions(counts, group, [value], weight="_n")
    last = (F.col("group_total") - 1).cast("double")

    def value_at(position: Column) -> Column:
        holds = (F.col("before") <= position) & (position < F.col("before") + F.col("_n"))
        return F.max(F.when(holds, F.col(value)))

    aggregates = [F.max(last).alias("_last")]
    for name, p in probabilities.items():
        aggregates.append(value_at(F.floor(last * F.lit(p))).alias(f"_lo_{name}"))
        aggregates.append(value_at(F.ceil(last * F.lit(p))).alias(f"_hi_{name}"))
    found = placed.groupBy(*group).agg(*aggregates)

    def interpolated(name: str, p: float) -> Column:
        position = F.col("_last") * F.lit(p)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*group, *[interpolated(n, p) for n, p in probabilities.items()])
