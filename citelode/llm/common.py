"""Shared pieces of the training-data operators: words, row keys, bounded filters."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.session import shared_table

#: A word, as every operator here reads it, and the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Longest filter, in 64-bit words: 8 MiB whatever the number of keys.
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str, text: Column) -> Column:
    """Hash that, beside ``doc_id`` itself, tells rows apart that repeat an id."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), text)


def same(left: Column, right: Column) -> Column:
    """Equality that holds for two nulls; Spark still plans a hash join for it."""
    return left.eqNullSafe(right)


@dataclass(frozen=True)
class BlockedBloom:
    """Bloom filter whose bits for one key lie in one 64-bit word.

    The low bits of a hash name the word, bits 40 to 63 the four bits in it. The filter
    is a one-row table that expressions read as a scalar subquery; its size is bounded by
    ``FILTER_WORDS``. More keys than fit only raise the share of false positives, and
    every user of the filter decides exactly afterwards.
    """

    stored: DataFrame
    size: int

    @staticmethod
    def _mask(hashed: Column) -> Column:
        def bit(shift: int) -> Column:
            place = F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(63)).cast("int")
            return F.call_function("shiftleft", F.lit(1).cast("long"), place)

        return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)).bitwiseOR(bit(58))

    @classmethod
    def build(cls, keys: DataFrame, column: str, most_words: int = FILTER_WORDS) -> BlockedBloom:
        """Filter over the hashes in ``column``; three keys share a word until the bound."""
        rows = keys.count()
        size = 1
        while size < most_words and size * 3 < rows:
            size *= 2
        hashed = F.col(column)
        filled = keys.groupBy(hashed.bitwiseAND(F.lit(size - 1)).alias("id")).agg(
            F.bit_or(cls._mask(hashed)).alias("bits")
        )
        every = keys.sparkSession.range(size).join(filled, "id", "left")
        words = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        return cls(shared_table(every.agg(F.transform(words, lambda word: word["bits"]).alias("words")), "filter"), size)

    @classmethod
    def _holds(cls, words: Column, size: int, hashed: Column) -> Column:
        place = hashed.bitwiseAND(F.lit(size - 1)) + 1
        return F.element_at(words, place.cast("int")).bitwiseAND(cls._mask(hashed)) == cls._mask(hashed)

    def _attached(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_llm_filter", self.stored.scalar())

    def split(self, df: DataFrame, hashed: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose hash may be a key, and the rows whose hash certainly is none. The
        hash goes through a one-element array, so that it is computed once for all its uses."""
        wide = self._attached(df)
        pair = F.array(F.struct(hashed.alias("hash"), F.col("_llm_filter").alias("words")))
        held = F.exists(pair, lambda x: self._holds(x["words"], self.size, x["hash"]))
        return wide.filter(held).drop("_llm_filter"), wide.filter(~held).drop("_llm_filter")

    def with_possible(self, df: DataFrame, name: str, values: Column, key: Callable[[Column], Column]) -> DataFrame:
        """``df`` with the elements of the array ``values`` whose hash ``key(element)`` may be a key."""
        copies = F.array_repeat(F.col("_llm_filter"), F.size(values))
        pairs = F.zip_with(values, copies, lambda value, words: F.struct(
            value.alias("value"), F.exists(F.array(key(value)), lambda h: self._holds(words, self.size, h)).alias("held")
        ))
        held = F.transform(F.filter(pairs, lambda pair: pair["held"]), lambda pair: pair["value"])
        return self._attached(df).withColumn(name, held).drop("_llm_filter")


_MEMORIES: list[dict] = []


def memory() -> dict:
    """A table that a Python worker keeps from task to task."""
    _MEMORIES.append({})
    return _MEMORIES[-1]


def forget() -> None:
    """Empty the tables of this worker, whichever operator filled them, and give their memory back: workers outlive
    the stage they were started for."""
    if not any(_MEMORIES):
        return
    for kept in _MEMORIES:
        kept.clear()
    give_back()


def give_back() -> None:
    """Give memory that this worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it, and alone keeps what was freed
    if trim:
        trim(0)


def tidy(work: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``work`` on a batch, after which the worker gives back what it freed: workers wait for their next task with
    what they hold, several to an executor, while the JVM beside them needs the room."""

    @functools.wraps(work)
    def tidied(*columns: pa.Array) -> pa.Array:
        try:
            return work(*columns)
        finally:
            give_back()

    return tidied


def portions(texts: pa.Array, most: int = 2_000_000, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each, so that working memory does not
    follow the rows of a batch; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > most or at - start >= rows):
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def one_of_each(docs: DataFrame, key: Column, judged: DataFrame) -> DataFrame:
    """``docs`` with the rows of groups that are judged to stay, one row per key.

    ``judged`` (materialised) has ``key, kept`` for the rows of groups of two or more; all other
    rows of ``docs`` stay and, but for the filter's false positives, never move."""
    possible, alone = BlockedBloom.build(judged.select("key").distinct(), "key").split(docs, key)
    lost = judged.filter("NOT kept").select(F.col("key").alias("_llm_lost")).distinct()
    marked = possible.withColumn("_llm_key", key)
    stay = marked.join(lost, F.col("_llm_key") == F.col("_llm_lost"), "left_anti").dropDuplicates(["_llm_key"])
    return alone.unionByName(stay.drop("_llm_key"))
