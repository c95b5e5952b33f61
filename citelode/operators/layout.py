"""Tables laid out by key, so that looking up a batch of keys reads few files and moves none of the rows.

The keys are dealt to slots by a hash; a slot is a folder whose files are sorted by key. A batch of keys reads the
folders of its slots only, and the keys, not the rows, are sent around.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators.sizing import BROADCAST_ROWS
from citelode.session import release_shuffles

#: Rows of a slot, on average.
SLOT_ROWS = 50_000
SLOT = "__slot"


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class Keyed:
    """A table at ``path`` laid out by the column ``key``."""

    rows: DataFrame
    key: str
    slots: int

    @classmethod
    def write(
        cls, df: DataFrame, path: str, key: str, rows: int, slot_rows: int = SLOT_ROWS, derived: Callable[[DataFrame], DataFrame] = lambda df: df
    ) -> Keyed:
        """Write ``df``, of about ``rows`` rows. A slot is one file, sorted by key, and has a task of its own. ``derived`` adds
        columns that follow from the others and need not be sent around."""
        slots = max(1, -(-rows // slot_rows))
        placed = df.withColumn(SLOT, slot_of(F.col(key), slots))
        dealt = derived(placed.repartitionById(slots, F.col(SLOT))).sortWithinPartitions(SLOT, key)
        stored = dealt.write.partitionBy(SLOT).option("compression", "zstd").option("parquet.bloom.filter.enabled#" + key, "true")
        stored.parquet(f"{path}/{slots}")
        release_shuffles(df.sparkSession)
        return cls(df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/{slots}"), key, slots)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str) -> Keyed:
        """The number of slots is the name of the one folder in ``path``."""
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
        slots = int([status.getPath().getName() for status in listed if status.isDirectory()][0])
        return cls(spark.read.parquet(f"{path}/{slots}"), key, slots)

    def slots_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the slots that hold some of the keys."""
        wanted = [row[0] for row in keys.select(slot_of(F.col(self.key), self.slots)).distinct().collect()]
        return self.rows.filter(F.col(SLOT).isin(wanted)) if len(wanted) < self.slots else self.rows

    def attach(self, asked: DataFrame, columns: list[str], rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
        """``asked`` (at most ``rows`` rows) with ``columns`` of its keys; unknown keys are left out. Beyond ``limit``
        rows the batch goes in pieces, each broadcast on its own."""
        pieces = max(1, -(-rows // limit))
        def part(piece: int) -> DataFrame:
            own = asked if pieces == 1 else asked.filter(F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(pieces)) == piece)
            return self.slots_for(own).select(self.key, *columns).join(F.broadcast(own), self.key)
        return reduce(DataFrame.unionByName, [part(piece) for piece in range(pieces)])

    def missing(self, asked: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
        """The rows of ``asked`` whose key is not in the table; only keys are read."""
        known = self.attach(asked.select(self.key).distinct(), [], rows, limit)
        return asked.join(F.broadcast(known) if rows <= limit else known, self.key, "left_anti")
