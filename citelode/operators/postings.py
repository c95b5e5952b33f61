"""Stored keyword index: postings in blocks with their largest impact, searched with safe skipping.

Chunks are dealt to shards by a hash and numbered in a shard in the order of their ids. A
posting block holds the chunks of one shard for one token, sorted by number, with the impact of the
token in each chunk; blocks lie in folders by token range. A batch of questions reads the
folders of its tokens only, and of them the asked blocks go to the task of their shard.

There a chunk is scored for a question only if it can enter the top k: the k-th largest impact of a
token, kept in the vocabulary, bounds the k-th score from below before anything is
read, and the largest impacts of the blocks bound what a chunk can reach from above.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citelode.functions import text as T
from citelode.operators.keyword import RANK_DECIMALS, best_first, keep_wanted, query_terms, top_k
from citelode.operators.sizing import small_side
from citelode.session import cut_lineage, release_shuffles
from citelode.sources import sinks

#: Chunks and words of a shard, and postings of a token folder, on average.
SHARD_CHUNKS, SHARD_WORDS, RANGE_POSTINGS = 32_768, 2_000_000, 4_000_000
#: Writers that the postings of one folder are spread over, at most.
SPREAD = 16
#: Largest impacts kept per token: the deepest k whose score is bounded before reading.
KEPT_IMPACTS = 64
#: Question terms that are searched in one pass.
TERM_BLOCK = 65_536
SLACK = 10.0 ** -(RANK_DECIMALS - 1)
#: Postings that a task passes on at once, about.
BATCH_POSTINGS = 200_000


@dataclass(frozen=True)
class KeywordIndex:
    chunks: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    n: int
    mean_length: float
    ranges: int

    @property
    def statistics(self) -> DataFrame:
        """``token, df, cf`` of the whole vocabulary."""
        return self.vocabulary.select("token", "df", "cf")


def token_range(token: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(ranges)).cast("int")


def _counted(chunks: DataFrame, names: list[str], packed: bool = False) -> DataFrame:
    """``names``, ``dl`` and ``runs``: the different tokens of each chunk with their counts, counted where the
    chunks lie. ``packed`` for the way to another task: their bytes in a row, and their sizes and counts as numbers of ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("tokens").flatten().dictionary_encode()
            known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(batch.column("tokens")).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)[known].astype(np.int64)
            width = max(1, len(coded.dictionary))
            cells, tf = np.unique(row * width + code, return_counts=True)
            ends = np.searchsorted(cells, np.arange(batch.num_rows + 1, dtype=np.int64) * width)
            words = coded.dictionary.take(pa.array(cells % width))
            entries = _packed(words, tf, ends) if packed else [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(tf, pa.int32())], names=["token", "tf"]))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in [*names, "dl"]), *entries], names=[*names, "dl", *held])

    kinds = dict(chunks.dtypes)
    held = {"width": "int", "words": "binary", "sizes": "binary"} if packed else {"runs": "array<struct<token:string,tf:int>>"}
    shape = "".join(f"`{name}` {kinds[name]}, " for name in names) + "dl int" + "".join(f", {name} {kind}" for name, kind in held.items())
    return chunks.select(*names, F.size("tokens").alias("dl"), "tokens").mapInArrow(run, shape)


def _packed(words: pa.Array, tf: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    _, places, letters = words.buffers()
    starts = np.frombuffer(places, np.int32)[: len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
    sizes = np.diff(starts)
    largest = max(sizes.max(initial=0), tf.max(initial=0))
    kind = np.dtype("u1" if largest < 1 << 8 else "<u2" if largest < 1 << 16 else "<u4")
    pairs = np.stack([sizes, tf], axis=1).astype(kind)
    cut = lambda bounds, held: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), held])
    return [
        pa.array(np.full(len(ends) - 1, kind.itemsize), pa.int32()), cut(starts[ends], letters or pa.py_buffer(b"")),
        cut(ends * 2 * kind.itemsize, pa.py_buffer(pairs.tobytes())),
    ]


#: Number, count and length of chunk of a posting on its way to its folder, where all of a shard fit and where not.
POSTING = tuple(np.dtype([("number", x), ("tf", y), ("dl", z)]) for x, y, z in (("<u2", "u1", "<u2"), ("<u4", "<u4", "<u4")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, shard, kind, postings`` of chunks that come shard by shard and by their numbers, packed as POSTING."""

    def blocks(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, lengths, widths, words, sizes = zip(*rows)
        pairs = [np.frombuffer(own, f"<u{width}").astype(np.int32).reshape(-1, 2) for own, width in zip(sizes, widths)]
        counts = np.array([len(own) for own in pairs])
        both = np.concatenate(pairs)
        if not len(both):
            return
        places = pa.py_buffer(np.append(0, np.cumsum(both[:, 0], dtype=np.int64)))
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both), [None, places, pa.py_buffer(b"".join(words))])
        coded = flat.dictionary_encode()
        # Rows come by number, so a stable order by token keeps the numbers of a block sorted.
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        code = coded.indices.to_numpy()[order]
        fields = np.repeat(np.array([(number, length or 0) for number, length in zip(numbers, lengths)], dtype=np.int64), counts, axis=0)[order]
        tf = both[:, 1][order]
        kind = int(fields.max() >= 1 << 16 or tf.max() >= 1 << 8)
        postings = np.empty(len(order), dtype=POSTING[kind])
        postings["number"], postings["tf"], postings["dl"] = fields[:, 0], tf, fields[:, 1]
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        bounds = np.append(starts, len(code))
        tokens = coded.dictionary.take(pa.array(code[starts])).cast(pa.binary()).cast(pa.string())
        for first, last in _portions(np.diff(bounds)):
            held = pa.py_buffer(postings[bounds[first] : bounds[last]].tobytes())
            ends = pa.py_buffer(((bounds[first : last + 1] - bounds[first]) * POSTING[kind].itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                tokens.slice(first, last - first), pa.array(np.full(last - first, shard), pa.int32()), pa.array(np.full(last - first, kind), pa.int32()),
                pa.Array.from_buffers(pa.binary(), last - first, [None, ends, held]),
            ], names=["token", "shard", "kind", "postings"])

    shard, held = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("shard", "number", "dl", "width", "words", "sizes")]
        for now, *row in zip(*columns):
            if now != shard:
                if held:
                    yield from blocks(shard, held)
                shard, held = now, []
            held.append(tuple(row))
    if held:
        yield from blocks(shard, held)


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of blocks with about BATCH_POSTINGS postings each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BATCH_POSTINGS, "right")))
        yield first, last
        first = last


def _opened(weight: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """``token, shard, range, n, cf, top, numbers, impacts`` of packed blocks. ``weight``: the impact of counts in chunks of some lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for kind, form in enumerate(POSTING):
                batch = whole.filter(pc.equal(whole.column("kind"), kind))
                sizes = pc.binary_length(batch.column("postings")).to_numpy(zero_copy_only=False) // form.itemsize
                for first, last in _portions(sizes):
                    part = batch.slice(first, last - first)
                    held = np.frombuffer(b"".join(part.column("postings").to_pylist()), form)
                    bounds = np.append(0, np.cumsum(sizes[first:last])).astype(np.int32)
                    impact = weight(held["tf"].astype(np.int64), held["dl"].astype(np.int64))
                    ends = pa.array(bounds)
                    yield pa.RecordBatch.from_arrays([
                        *(part.column(name) for name in ("token", "shard", "range")), pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(held["tf"], bounds[:-1], dtype=np.int64)), pa.array(np.maximum.reduceat(impact, bounds[:-1])),
                        pa.ListArray.from_arrays(ends, pa.array(held["number"].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(impact)),
                    ], names=["token", "shard", "range", "n", "cf", "top", "numbers", "impacts"])

    return run


def build(chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, keep: tuple[str, ...] = ("category",)) -> None:
    """Write the index of ``chunk_id, tokens`` and the columns ``keep`` under ``path``."""
    spark = chunks.sparkSession
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("words")).first()
    n, words = size["n"], size["words"]
    mean = words / n if n else 0.0
    shards = max(1, -(-n // SHARD_CHUNKS), min(n, -(-words // SHARD_WORDS)))
    shards = max(shards, min(n, spark.sparkContext.defaultParallelism)) if n else 1
    ranges = max(1, -(-words // RANGE_POSTINGS))
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")
    number = F.row_number().over(Window.partitionBy("shard").orderBy("chunk_id")) - 1
    numbered = chunks.select("chunk_id", *keep, F.size("tokens").alias("dl"), shard.alias("shard")).withColumn("number", number)
    numbered.select("shard", "number", "chunk_id", "dl", *keep).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def weight(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + k1 * (1 - b + b * dl / mean if mean else 1.0))

    # The chunks lie by shard and number already, so a shard is one stretch of a task.
    placed = _counted(chunks, ["chunk_id"], packed=True).withColumn("shard", shard).withColumn("number", number)
    blocks = placed.select("shard", "number", "dl", "width", "words", "sizes").mapInArrow(_blocks, "token string, shard int, kind int, postings binary")
    # Postings go to their folders packed and are opened there.
    packed = blocks.withColumn("range", token_range(F.col("token"), ranges)).repartition("range", F.col("shard") % SPREAD)
    opened = packed.mapInArrow(
        _opened(weight), "token string, shard int, range int, n int, cf long, top double, numbers array<int>, impacts array<double>"
    )
    dealt = opened.sortWithinPartitions("range", "token", "shard")
    dealt.write.partitionBy("range").option("compression", "zstd").parquet(f"{path}/postings")
    release_shuffles(spark)

    largest = lambda lists: F.slice(F.sort_array(F.flatten(F.collect_list(lists)), asc=False), 1, KEPT_IMPACTS)
    own = F.slice(F.sort_array("impacts", asc=False), 1, KEPT_IMPACTS)
    stored = _read_postings(spark, path)
    groups = stored.groupBy("range", "token", F.floor(F.col("shard") / 64).alias("some")).agg(
        F.sum("n").alias("df"), F.sum("cf").alias("cf"), largest(own).alias("largest")
    ).groupBy("range", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), largest(F.col("largest")).alias("largest"))
    groups.repartition("range").sortWithinPartitions("range", "token").write.partitionBy("range").option("compression", "zstd").parquet(f"{path}/vocabulary")
    release_shuffles(spark)
    settings = {"n": n, "mean_length": mean, "ranges": ranges, "shards": shards, "k1": k1, "b": b}
    sinks.write_text(spark, json.dumps(settings, sort_keys=True), f"{path}/keyword.json")


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    schema = "token string, shard int, n int, cf long, top double, numbers array<int>, impacts array<double>, range int"
    return spark.read.schema(schema).parquet(f"{path}/postings")


def open_keywords(spark: SparkSession, path: str) -> KeywordIndex:
    stored = sinks.read_text(spark, f"{path}/keyword.json")
    if stored is None:
        raise FileNotFoundError(f"no keyword index at {path}")
    settings = json.loads(stored)
    vocabulary = spark.read.schema("token string, df long, cf long, largest array<double>, range int").parquet(f"{path}/vocabulary")
    return KeywordIndex(
        spark.read.parquet(f"{path}/chunks"), vocabulary, _read_postings(spark, path),
        settings["n"], settings["mean_length"], settings["ranges"],
    )


def asked_only(stored: DataFrame, tokens: DataFrame, ranges: int) -> DataFrame:
    """Rows of the asked tokens; only their folders are read."""
    folders = [row["range"] for row in tokens.select(token_range(F.col("token"), ranges).alias("range")).distinct().collect()]
    inside = stored if len(folders) == ranges else stored.filter(F.col("range").isin(folders))
    return inside.join(small_side(tokens.select("token").distinct()), "token", "left_semi")


def term_statistics(index: KeywordIndex, tokens: DataFrame) -> DataFrame:
    """``token, df, cf, largest`` of the asked tokens that the corpus has."""
    return asked_only(index.vocabulary, tokens, index.ranges).drop("range")


def search(index: KeywordIndex, queries: DataFrame, k: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Top ``k`` chunks per question with a positive score: ``qid, chunk_id, score, rank`` and the
    columns ``keep``. ``queries``: qid, tokens; repeated tokens count each time."""
    spark = queries.sparkSession
    terms = query_terms(queries.filter(F.col("qid").isNotNull()))
    known = cut_lineage(terms.join(small_side(term_statistics(index, terms)), "token"))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floor = F.coalesce(F.get("largest", F.lit(k - 1)), F.lit(0.0))
    weighted = known.withColumn("weight", F.col("qtf") * idf).select("qid", "token", "weight", (F.col("weight") * floor).alias("floor"))
    total = weighted.count()
    pieces = max(1, -(-total // TERM_BLOCK))
    qid = queries.schema["qid"].dataType
    hits = None
    for piece in range(pieces):
        some = weighted if pieces == 1 else weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(pieces)) == piece)
        rows = some.collect()
        if not rows:
            continue
        asked = spark.createDataFrame([(token,) for token in sorted({row["token"] for row in rows})], "token string")
        blocks = asked_only(index.postings, asked, index.ranges).select("shard", "token", "top", "numbers", "impacts")
        found = blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            _shard_search(spark.sparkContext.broadcast(_questions(rows)), k, to_arrow_type(qid)),
            f"qid {qid.simpleString()}, shard int, number int, score double",
        )
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        kinds = {name: kind for name, kind in index.chunks.dtypes}
        shape = f"qid {qid.simpleString()}, chunk_id string, score double" + "".join(f", {c} {kinds[c]}" for c in keep)
        return spark.createDataFrame([], shape + ", rank int")
    shards = index.chunks.select("shard", "number", "chunk_id", *keep)
    found = hits.join(shards, ["shard", "number"]).select("qid", "chunk_id", "score", *keep)
    return top_k(found, ["qid"], best_first("score"), k)


def _questions(rows) -> dict:
    """Terms of each question, and the score that its k-th chunk reaches at least."""
    asked: dict = {}
    for row in rows:
        entry = asked.setdefault(row["qid"], ([], 0.0))
        entry[0].append((row["token"], row["weight"]))
        asked[row["qid"]] = (entry[0], max(entry[1], row["floor"]))
    return asked


def _shard_search(shared, k: int, qid_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {qid: Best(k, floor) for qid, (_, floor) in shared.value.items()}
        shard, held = None, {}

        def close() -> None:
            for qid, (terms, _) in shared.value.items():
                lists = [(weight, *held[token]) for token, weight in terms if token in held]
                if lists:
                    best[qid].add(shard, *scored(lists, k, best[qid].bound))

        for batch in batches:
            shards, names, tops = (batch[name].to_pylist() for name in ("shard", "token", "top"))
            for at, now in enumerate(shards):
                if now != shard:
                    if held:
                        close()
                    shard, held = now, {}
                held[names[at]] = (tops[at], np.asarray(batch["numbers"][at].values), np.asarray(batch["impacts"][at].values))
        if held:
            close()
        rows = [(qid, *row) for qid, top in best.items() for row in top.rows]
        types = (qid_type, pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in rows], type_) for i, type_ in enumerate(types)], names=["qid", "shard", "number", "score"]
        )

    return run


class Best:
    """The chunks of a question so far: all that can be among its k best. Equal rounded scores stay, since
    ids decide between them only later."""

    def __init__(self, k: int, floor: float):
        self.k, self.bound, self.rows = k, floor, []

    def add(self, shard: int, numbers: np.ndarray, scores: np.ndarray) -> None:
        self.rows += [(shard, int(number), float(score)) for number, score in zip(numbers, scores)]
        if len(self.rows) > self.k:
            rounded = sorted((round(row[2], RANK_DECIMALS) for row in self.rows), reverse=True)
            self.bound = max(self.bound, rounded[self.k - 1])
            self.rows = [row for row in self.rows if row[2] > self.bound - SLACK]


def scored(lists: list[tuple[float, float, np.ndarray, np.ndarray]], k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a shard whose score may reach ``bound``, with their exact scores, the k best and their ties.
    ``lists``: weight, largest impact, chunk numbers, impacts of each term.

    Terms are taken by what they can add, largest first. Once the terms left cannot lift a chunk over the
    bound by themselves, no new chunks are taken up, and the lists left are only looked up for
    chunks that are still in reach."""
    lists = sorted((one for one in lists if len(one[2])), key=lambda x: -x[0] * x[1])
    left = np.append(np.cumsum([weight * top for weight, top, _, _ in lists][::-1])[::-1], 0.0)
    size = max((int(chunk[-1]) for _, _, chunk, _ in lists), default=-1) + 1
    scores, taken = np.zeros(size), np.zeros(size, dtype=bool)
    closed = False
    for at, (weight, _, chunk, impact) in enumerate(lists):
        if closed or left[at] + SLACK < bound:
            closed = True
            taken &= scores + left[at] + SLACK >= bound
            known = taken[chunk]
            scores[chunk[known]] += weight * impact[known]
        else:
            scores[chunk] += weight * impact
            taken[chunk] = True
        # The bound is raised after the 1st, 2nd, 4th ... term, and after the last one.
        if not at & (at + 1) or at + 1 == len(lists):
            values = scores[taken]
            if len(values) > k:
                bound = max(bound, float(np.partition(values, len(values) - k)[len(values) - k]) - SLACK)
    numbers = np.flatnonzero(taken & (scores + SLACK >= bound))
    return numbers, scores[numbers]


def filtered_search(index: KeywordIndex, queries: DataFrame, filters: DataFrame, k: int = 20, overfetch: int = 3) -> DataFrame:
    """As ``keyword.filtered_sparse_search``, on the stored index."""
    return keep_wanted(search(index, queries, overfetch * k, ("category",)), filters, k)
