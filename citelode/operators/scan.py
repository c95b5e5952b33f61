"""Running values over long ordered groups.

A plain window sends a whole group to one task. Here each group is cut into blocks
that follow its order; windows run per block, and what a block needs from the blocks
before it comes from one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a block of consecutive integers spans.
BLOCK_SPAN = 4096


def integer_block(position: Column, span: int = BLOCK_SPAN) -> Column:
    return F.floor(position / span)


def hash_order(*parts: Column) -> Column:
    """Reproducible shuffle key: hex digest, sortable as text."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_block(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: up to 16**digits evenly filled blocks in digest order."""
    return F.substring(digest, 1, digits)


def _with_block_totals(
    df: DataFrame, group: list[str], block: str, total: Column, name: str
) -> DataFrame:
    """Attach ``total`` over all earlier blocks of the group as ``name``."""
    before = (
        Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = df.groupBy(*group, block).agg(total.alias("__total"))
    carried = sums.select(
        *group, block, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(name)
    )
    return df.join(carried, [*group, block])


def blocked_row_number(
    df: DataFrame, group: list[str], block: str, order: list[Column], name: str = "row_no"
) -> DataFrame:
    """``row_number`` per group, counted per block. ``block`` must agree with ``order``."""
    within = Window.partitionBy(*group, block).orderBy(*order)
    counted = _with_block_totals(df, group, block, F.count(F.lit(1)), "__before")
    return counted.withColumn(
        name, (F.row_number().over(within) + F.col("__before")).cast("long")
    ).drop("__before")


def blocked_running_sum(
    df: DataFrame, group: list[str], block: str, order: list[Column], value: str, name: str
) -> DataFrame:
    """Running sum per group, this row included."""
    within = (
        Window.partitionBy(*group, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = _with_block_totals(df, group, block, F.sum(value), "__before")
    return summed.withColumn(name, F.sum(value).over(within) + F.col("__before")).drop("__before")


def blocked_last_value(
    df: DataFrame, group: list[str], block: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its group."""
    ordered = Window.partitionBy(*group, block).orderBy(*order)
    strictly_before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__value", value)
    # max_by gives each block's own last value without a sort; it passes over rows whose ordering is null, here those
    # without a value. A block that has none keeps its row, since it carries on what came before.
    position = order[0] if len(order) == 1 else F.struct(*order)
    tails = df.groupBy(*group, block).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), position)).alias("__tail")
    )
    earlier = (
        Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        *group, block, F.last("__tail", ignorenulls=True).over(earlier).alias("__carried")
    )
    # The window comes before the join, which then finds its rows sorted.
    own = df.withColumn("__own", F.last("__value", ignorenulls=True).over(strictly_before))
    return (
        own.join(carried, [*group, block])
        .withColumn(name, F.coalesce("__own", "__carried"))
        .drop("__value", "__own", "__carried")
    )
