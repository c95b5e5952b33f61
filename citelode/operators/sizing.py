"""Joins against a side that is usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast. Lookup rows are a few short
#: columns, so this stays in the tens of megabytes.
BROADCAST_ROWS = 500_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is within ``rows``, otherwise unchanged, so
    that the join shuffles and adaptive execution splits hot keys."""
    return F.broadcast(df) if is_small(df, rows) else df


def within(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by ``rows`` from elsewhere
    (queries times k, say), so nothing has to be counted."""
    return F.broadcast(df) if rows <= limit else df


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """Join facts to a lookup that has few rows per key.

    A lookup within ``rows`` is broadcast. A larger one is replicated ``salts`` times
    and the facts are spread over the copies, so one hot key becomes ``salts`` keys.
    """
    if is_small(lookup, rows):
        return facts.join(F.broadcast(lookup), on, how)
    # The salt depends on the row alone, so a recomputed task salts as before.
    spread = facts.withColumn(
        "__salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    )
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")
