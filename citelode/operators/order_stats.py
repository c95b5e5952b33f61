"""Exact order statistics for groups of any size.

Equal values are counted first, distinct values are cut into ranges at shared
quantiles, and only the range that holds the wanted rank is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interior cut points of the shared ranges.
CUTS = 63


# Zero-based rank of the wanted value among ``n`` sorted ones. Several conventions are in
# use, so each has a name.
def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Half-even rounding of ``p/100 * (n-1)``."""
    return lambda n: F.bround(F.lit(p / 100) * (n - 1)).cast("long")


def floor_rank(fraction: float) -> Callable[[Column], Column]:
    """``n`` times the fraction, rounded down."""
    return lambda n: F.floor(n * F.lit(fraction))


def covering_rank(fraction: float) -> Callable[[Column], Column]:
    """Smallest rank that covers the fraction."""
    return lambda n: (F.ceil(F.lit(fraction) * n) - 1).cast("long")


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def order_statistics(
    df: DataFrame,
    group: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    of: str | None = None,
) -> DataFrame:
    """One row per group with the value at each named rank; nulls in ``value`` do not
    count. ``of`` names a column holding the ``n`` to take ranks of when it is not the
    number of values (ranks beyond the values give null)."""
    base = df.filter(F.col(value).isNotNull())
    counting = [F.count(F.lit(1)).alias("__c")]
    if of:
        counting.append(F.max(of).alias("__of"))
    counts = base.groupBy(*group, value).agg(*counting)
    points = [F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)]
    cuts = counts.agg(F.percentile_approx(value, F.array(*points), F.lit(1000))).scalar()
    ranged = counts.withColumn("__cuts", cuts).withColumn(
        "__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))
    ).drop("__cuts")
    sizes = ranged.groupBy(*group, "__range").agg(
        F.sum("__c").alias("__size"), *([F.max("__of").alias("__of")] if of else [])
    )
    whole = Window.partitionBy(*group)
    earlier = (
        whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.max("__of").over(whole) if of else F.sum("__size").over(whole)
    wanted = (
        sizes.withColumn("__start", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .withColumn("__n", n)
        .withColumn(
            "__pick",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("k"), rank(F.col("__n")).cast("long").alias("i"))
                        for k, rank in ranks.items()
                    ]
                )
            ),
        )
        .select(*group, "__range", "__start", "__size", "__pick.k", "__pick.i")
        .filter((F.col("i") >= F.col("__start")) & (F.col("i") < F.col("__start") + F.col("__size")))
    )
    running = (
        Window.partitionBy(*group, "__range")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranged.withColumn("__upto", F.sum("__c").over(running)).select(
        *group, "__range", F.col(value).alias("__v"), "__c", "__upto"
    )
    found = wanted.join(placed, [*group, "__range"]).filter(
        (F.col("i") < F.col("__start") + F.col("__upto"))
        & (F.col("i") >= F.col("__start") + F.col("__upto") - F.col("__c"))
    )
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("k") == k, F.col("__v"))).alias(k) for k in ranks]
    )
