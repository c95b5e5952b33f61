"""Passages that repeat, found by super-k-mers.

A window is ``WINDOW`` consecutive words. The minimiser of a window is the least hash of
the runs of ``RUN`` words inside it, so equal windows have equal minimisers wherever they stand.
Consecutive windows with one minimiser travel as one packed string of words to the bucket
of that minimiser, and the windows are counted there, by their words.

Which strings travel: the places of minimisers are counted first, hashes only, and a
minimiser with one place anywhere cannot hide a repeat. A bounded Bloom filter of the others goes to the tasks; what it
lets through wrongly is counted like the rest. A minimiser with more than ``HOT`` places has no
bucket of its own: its windows are counted by their words over all tasks, with partial
sums, and joined back.

Defined cases: a null or empty text, or one with fewer than ``WINDOW`` words, has no windows
and stays as it is. Rows that repeat are different places, so their windows repeat. Rows
that repeat an id with different texts are told apart by the text. Windows are judged on the
input. Other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import BlockedBloom, portions, row_key, same, whole_text
from citelode.session import shared_table

WINDOW = 35
RUN = 16
#: Places of a minimiser beyond which its windows are spread over all tasks.
HOT = 2_000
#: Windows in one packed string at most.
PACKED = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def minimisers(words: list[bytes], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of every window of ``words``, and the one of every place that is the
    minimiser of some window over it; signed 64-bit numbers.

    Two equal windows have their minimisers in two places, also when they overlap in one
    periodic stretch, so a minimiser with one place hides no repeat."""
    n = len(words)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    runs = np.zeros(n - run + 1, dtype=np.uint64)
    for at in range(run):
        runs = runs * _MULTIPLIER + hashed[at : at + len(runs)]
    runs = _mixed(runs)
    inside = window - run + 1
    least = np.lib.stride_tricks.sliding_window_view(runs, inside).min(axis=1)
    edge = np.zeros(inside - 1, dtype=np.uint64)
    over = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, least, edge]), inside).max(axis=1)
    return least.view(np.int64), runs[over == runs].view(np.int64)


def super_kmers(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end window of each stretch with one minimiser, at most PACKED windows."""
    if not len(least):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([firsts[1:], [len(least)]])
    if (ends - firsts).max() > PACKED:
        cut = [np.arange(a, b, PACKED) for a, b in zip(firsts, ends, strict=True)]
        firsts = np.concatenate(cut)
        ends = np.concatenate([firsts[1:], [len(least)]])
    return firsts, ends


def minimiser_counts(docs: DataFrame, text: str) -> DataFrame:
    """``minimiser, seen`` for minimisers with more than one place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in portions(batch.column(0)):
                found = []
                for value in batch.column(0).slice(start, end - start).to_pylist():
                    found.append(minimisers(value.encode().split())[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["minimiser"])

    every = docs.select(whole_text(text).alias("text")).mapInArrow(work, "minimiser long")
    return every.groupBy("minimiser").agg(F.count("*").alias("seen")).filter("seen > 1")


def _bits(bloom: BlockedBloom) -> np.ndarray:
    """The filter itself, at most FILTER_WORDS numbers."""
    return bloom.stored.toArrow().column("words")[0].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _may_hold(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    key = hashed.view(np.uint64)
    mask = np.zeros(len(key), dtype=np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.uint64(1) << ((key >> np.uint64(shift)) & np.uint64(63))
    return words[(key & np.uint64(len(words) - 1)).astype(np.int64)] & mask == mask


_TRAVELLING = "doc_id long, row long, bucket long, hot boolean, start int, packed string"
_TRAVELLING_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("bucket", pa.int64()), ("hot", pa.bool_()), ("start", pa.int32()), ("packed", pa.string()),
])


def travelling(rows: DataFrame, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Packed strings of the minimisers that the filter lets through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in portions(batch.column(2)):
                some, out = batch.slice(start, end - start), []
                for doc, row, value in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    words = value.encode().split()
                    least, _ = minimisers(words)
                    firsts, ends = super_kmers(least)
                    if not len(firsts):
                        continue
                    own = least[firsts]
                    goes, is_hot = _may_hold(repeated, own), _may_hold(hot, own)
                    for i in np.flatnonzero(goes).tolist():
                        first = int(firsts[i])
                        packed = b" ".join(words[first : int(ends[i]) + WINDOW - 1])
                        out.append((doc, row, int(own[i]), bool(is_hot[i]), first, packed.decode()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _TRAVELLING_ARROW, strict=True)], schema=_TRAVELLING_ARROW
                    )

    return rows.mapInArrow(work, _TRAVELLING)


def windows_of(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    places = np.cumsum([0, *[len(word) + 1 for word in words]]).tolist()
    return [packed[places[i] : places[i + WINDOW] - 1] for i in range(len(words) - WINDOW + 1)]


def _spans(start: int, flags: list[bool]) -> Iterator[tuple[int, int]]:
    """Word spans that flagged windows cover."""
    first = None
    for i, flag in enumerate([*flags, False]):
        if flag and first is None:
            first = i
        elif not flag and first is not None:
            yield start + first, start + i - 1 + WINDOW
            first = None


_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows; rows come sorted by bucket, each bucket at most HOT strings
    (or what a hash collision in the filters adds)."""

    def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = [windows_of(packed.encode()) for packed in part.column("packed").to_pylist()]
        seen = Counter(window for windows in cut for window in windows)
        out = []
        for doc, row, start, windows in zip(*(part.column(name).to_pylist() for name in ("doc_id", "row", "start")), cut, strict=True):
            out += [(doc, row, *span) for span in _spans(start, [seen[window] > 1 for window in windows])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SPANS_ARROW, strict=True)], schema=_SPANS_ARROW)

    held: pa.Table | None = None
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        held = fresh if held is None else pa.concat_tables([held, fresh])
        buckets = held.column("bucket").to_numpy()
        changes = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
        if len(changes):
            whole = int(changes[-1])
            yield from done(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield from done(held)


def _hot_spans(hot: DataFrame) -> DataFrame:
    """The same for minimisers without a bucket. Equal strings become one row with a count
    before their windows are looked at, and places get their spans by the whole string."""
    name = [F.xxhash64("packed").alias("p1"), F.xxhash64("packed", F.lit(1)).alias("p2")]
    words = F.split("packed", " ")
    strings = hot.groupBy("packed").agg(F.count("*").alias("n")).select(*name, "n", words.alias("words"))
    each = strings.select("p1", "p2", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - WINDOW)).alias("at"))
    windows = each.select("p1", "p2", "n", "at", F.array_join(F.slice("words", F.col("at") + 1, F.lit(WINDOW)), " ").alias("window"))
    keys = [F.xxhash64("window").alias("k1"), F.xxhash64("window", F.lit(1)).alias("k2")]
    twice = windows.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select(*keys)
    flagged = windows.select("p1", "p2", "at", *keys).join(twice, ["k1", "k2"])
    flagged = flagged.groupBy("p1", "p2").agg(F.collect_list("at").alias("places"))  # PACKED at most
    span = lambda at: F.struct((F.col("start") + at).alias("first"), (F.col("start") + at + WINDOW).alias("end"))
    placed = hot.select("doc_id", "row", "start", *name).join(flagged, ["p1", "p2"])
    return placed.select("doc_id", "row", F.transform("places", span).alias("spans"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, spans``: the word spans of each document that repeated windows cover."""
    counts = shared_table(minimiser_counts(docs, text), "minimisers")
    repeated = _bits(BlockedBloom.build(counts, "minimiser"))
    hot = _bits(BlockedBloom.build(counts.filter(F.col("seen") > HOT), "minimiser"))
    raw = whole_text(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, raw).alias("row"), raw.alias("text"))
    strings = shared_table(travelling(rows, repeated, hot), "strings")
    cold = strings.filter("NOT hot").repartition("bucket").sortWithinPartitions("bucket")
    counted = cold.mapInArrow(_count_buckets, "doc_id long, row long, first int, end int")
    spans = counted.select("doc_id", "row", F.array(F.struct("first", "end")).alias("spans")).unionByName(_hot_spans(strings.filter("hot")))
    return spans.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


@F.arrow_udf(_KEPT)
def take_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts.to_pylist(), spans, strict=True):
        words = text.encode().split()
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for span in cut.as_py() or ():
            gone[span["first"]] += 1
            gone[span["end"]] -= 1
        stays = np.cumsum(gone)[: len(words)] == 0
        kept = words if stays.all() else [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
        out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept_text": b" ".join(kept).decode()})
    return pa.array(out, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row. Only documents with repeats are
    joined, so only their texts are shuffled."""
    spans = shared_table(repeated_spans(docs, doc_id, text), "spans")
    bloom = BlockedBloom.build(spans, "row")
    raw = whole_text(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, raw).alias("row"), raw.alias("text"))
    possible, alone = bloom.split(rows, F.col("row"))
    known = spans.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "spans").hint("shuffle_hash")
    joined = possible.join(known, same(F.col("doc_id").cast("long"), F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = F.lit(None).cast("array<struct<first:int,end:int>>")
    every = alone.select("doc_id", "text", none.alias("spans")).unionByName(joined.select("doc_id", "text", "spans"))
    return every.select("doc_id", take_out("text", "spans").alias("out")).select("doc_id", "out.*")


#: The same in DuckDB.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS k FROM words, range(1, len(w) - 33) AS starts(s)),
twice AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, p FROM twice, range(s, s + 35) AS places(p)),
lost AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY p) AS kept_text
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) AS words
  LEFT JOIN gone USING (r, p) WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM words LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
