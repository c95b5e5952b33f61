"""Nearest neighbours by a forest of random-projection trees.

A tree splits at every level along one random direction, at the median of the vectors that
reach the node; the directions of a tree are orthogonal, so that the squared margins passed on
the wrong side add up to a lower bound of the squared distance to a cell. The forest is fitted on a
bounded sample and is small; every vector is indexed.

A query walks all trees through one priority queue, nearest cell first, until the leaves that
it has opened hold ``budget`` rows. The vectors travel once per tree to the task of their
subtree, the queries follow to the subtrees where they opened leaves, and the distances of the leaf
candidates are computed there on the original vectors in double precision. ``budget`` is found by
measuring: for a bounded number of probe queries the exact neighbours are computed in one scan, and
the budget is the number of rows at which ``TARGET`` of these neighbours have come up.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, and rows without an id neither. A query compares with vectors of its own length. A row's own
id is never its neighbour; rows that repeat id and vector are one row; an id with several vectors
is a query for each of them. Of equal vectors the ``k + 1`` smallest ids are kept, since no others
can be among the k nearest. Equal distances order by id. Fewer candidates than k give fewer rows,
and no rows give none. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.session import shared_table

TREES = 4
#: Vectors that the split points are fitted on: at most so many rows and so many bytes.
FIT_ROWS, FIT_BYTES = 32_768, 64_000_000
#: Sampled vectors of a leaf.
LEAF_ROWS = 16
#: Rows of a subtree that one task holds; larger ones are cut by a hash of the id.
CELL_ROWS = 8_192
#: Probe queries of the calibration, and the share of their neighbours that has to come up.
PROBES, TARGET = 64, 0.95
SEED = 20_240_611


@dataclass(frozen=True)
class Forest:
    """Directions (trees, dim, depth) and split points (trees, 2 ** depth, by node number)."""

    directions: np.ndarray
    splits: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
        rows, dim = sample.shape
        depth = max(1, int(np.ceil(np.log2(max(1, rows / leaf_rows)))))
        rng = np.random.default_rng(seed)
        directions = np.empty((trees, dim, depth))
        splits = np.zeros((trees, 1 << depth))
        for tree in range(trees):
            bases = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-depth // dim))]
            directions[tree] = np.concatenate(bases, axis=1)[:, :depth]
            along = sample @ directions[tree]
            node = np.ones(rows, dtype=np.int64)
            for level in range(depth):
                order = np.lexsort((along[:, level], node))
                starts = np.searchsorted(node[order], np.arange(1 << level, (1 << level + 1) + 1))
                middles = (starts[:-1] + starts[1:]) // 2
                filled = starts[1:] > starts[:-1]
                at = order[np.minimum(middles, rows - 1)]
                splits[tree, 1 << level:1 << level + 1] = np.where(filled, along[at, level], 0.0)
                node = 2 * node + (along[:, level] >= splits[tree, node])
        return cls(directions, splits, depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.empty((len(vectors), len(self.splits)), dtype=np.int32)
        for tree, splits in enumerate(self.splits):
            along = vectors @ self.directions[tree]
            node = np.ones(len(vectors), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + (along[:, level] >= splits[node])
            out[:, tree] = node - (1 << self.depth)
        return out

    def opened(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first over all trees together."""
        along = [(vector @ directions).tolist() for directions in self.directions]
        queue = [(0.0, tree, 1, 0) for tree in range(len(along))]
        first = 1 << self.depth
        while queue:
            cost, tree, node, level = heapq.heappop(queue)
            place, splits = along[tree], self.splits[tree]
            while level < self.depth:
                margin = place[level] - splits[node]
                near = 2 * node + (margin >= 0)
                level += 1
                heapq.heappush(queue, (cost + margin * margin, tree, near ^ 1, level))
                node = near
            yield tree, node - first


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and one of them is not zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose lists have one length, as doubles."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gaps = rows - query
    return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))


def nearest_of(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows other than the query's own id."""
    keep = ids != own
    rows, ids = rows[keep], ids[keep]
    found = distances(rows, query)
    if len(found) > k:
        worst = np.partition(found, k - 1)[k - 1]
        near = found <= worst
        found, ids = found[near], ids[near]
    order = np.lexsort((ids, found))[:k]
    return ids[order], found[order]


def exact_nearest(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Brute force in one scan: ``id, vector`` against a bounded list of queries. A task keeps
    the k nearest of each query. Gives ``place`` (of the query), ``id, vector, score, rank``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            ids, found = np.asarray(batch["id"]), matrix(batch["vector"])
            for place, (own, query) in enumerate(queries):
                near, score = nearest_of(found, np.arange(len(ids)), query, -1, k + 1)
                fresh = [(s, int(ids[i]), found[i]) for i, s in zip(near, score) if ids[i] != own]
                best[place] = sorted(best[place] + fresh, key=lambda x: x[:2])[:k]
        flat = [(place, row_id, vector, score) for place, rows_ in enumerate(best) for score, row_id, vector in rows_]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64()),
                 pa.array([x[2].tolist() for x in flat], pa.list_(pa.float64())), pa.array([x[3] for x in flat], pa.float64())],
                names=["place", "id", "vector", "score"],
            )

    found = rows.select("id", "vector").mapInArrow(scan, "place int, id long, vector array<double>, score double")
    order = Window.partitionBy("place").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _spread_sample(rows: DataFrame, total: int, most: int) -> list:
    """About ``most`` rows and at most twice as many, chosen by a hash of the id."""
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    chosen = rows if total <= most else rows.filter(part < int((1 << 30) * most / total))
    return chosen.limit(2 * most)


def _prepare(vectors: DataFrame, id_column: str, vector_column: str, k: int) -> DataFrame:
    kind = vectors.schema[vector_column].dataType.simpleString()
    kept = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kept).alias("vector")
    )
    rows = rows.withColumn("key", F.xxhash64("vector")).dropDuplicates(["key", "id", "vector"])
    order = Window.partitionBy("key", "vector").orderBy("id")
    return rows.withColumn("copy", F.row_number().over(order))


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    trees: int = TREES, target: float = TARGET,
) -> DataFrame:
    """The k nearest rows of every row for which ``is_query`` (on the column ``id``) holds:
    ``query_id, rank, id, score``."""
    rows = _prepare(vectors, id_column, vector_column, k)
    # A query needs its own row also where it is a copy beyond the smallest ids.
    rows = shared_table(rows.filter((F.col("copy") <= k + 1) | is_query).withColumn("dim", F.size("vector")), "vectors")
    lengths = sorted((row["dim"], row["count"]) for row in rows.groupBy("dim").count().collect())
    parts = [_search_length(rows.filter(F.col("dim") == dim), is_query, k, dim, total, trees, target) for dim, total in lengths]
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    return found


def _search_length(
    rows: DataFrame, is_query: Column, k: int, dim: int, total: int, trees: int, target: float
) -> DataFrame:
    sample = _spread_sample(rows.select("id", "vector"), total, min(FIT_ROWS, max(256, FIT_BYTES // (8 * dim))))
    forest = Forest.fit(matrix(sample.select("vector").toArrow()["vector"]), trees)
    indexed = _index(rows, forest)
    counts = _leaf_counts(indexed, forest)
    budget = calibrate(indexed, is_query, forest, counts, k, target)
    return _visit(indexed, is_query, forest, counts, budget, k)


def _index(rows: DataFrame, forest: Forest) -> DataFrame:
    """Every row with its leaf in every tree, written once."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(matrix(batch["vector"])) if len(batch) else np.empty((0, 1), dtype=np.int32)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], batch["copy"], listed], names=["id", "vector", "copy", "leaves"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = rows.select("id", "vector", "copy").mapInArrow(place, f"id long, vector {kind}, copy int, leaves array<int>")
    return shared_table(placed, "forest")


def _leaf_counts(indexed: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of every leaf of every tree; as many numbers as the forest has leaves."""
    counts = np.zeros((len(forest.splits), 1 << forest.depth), dtype=np.int64)
    listed = indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    for row in listed.collect():
        counts[row["tree"], row["leaf"]] = row["count"]
    return counts


def calibrate(
    indexed: DataFrame, is_query: Column, forest: Forest, counts: np.ndarray, k: int, target: float
) -> int:
    """Rows that the opened leaves of a query have to hold: the measured number at which the share
    ``target`` of the probes' exact neighbours has come up."""
    wanted = indexed.filter(is_query).select("id", "vector", F.xxhash64("id", F.lit(SEED + 1)).alias("place"))
    probes = [(row["id"], np.array(row["vector"], dtype=np.float64)) for row in wanted.orderBy("place", "id").limit(PROBES).collect()]
    if not probes:
        return 0
    reached: list[int] = []
    truth: list[list[np.ndarray]] = [[] for _ in probes]
    for row in exact_nearest(indexed, probes, k).collect():
        truth[row["place"]].append(np.array(row["vector"]))
    for (_, vector), near in zip(probes, truth):
        if not near:
            continue
        open_leaves = {(tree, int(leaf)) for leaves in forest.leaves(np.array(near)) for tree, leaf in enumerate(leaves)}
        taken, seen = 0, {}
        for tree, leaf in forest.opened(vector):
            taken += int(counts[tree, leaf])
            if (tree, leaf) in open_leaves:
                seen[tree, leaf] = taken
                if len(seen) == len(open_leaves):
                    break
        for leaves in forest.leaves(np.array(near)):
            reached.append(min(seen[tree, int(leaf)] for tree, leaf in enumerate(leaves)))
    if not reached:
        return 0
    return sorted(reached)[min(len(reached) - 1, int(np.ceil(target * len(reached))))]


def _visit(indexed: DataFrame, is_query: Column, forest: Forest, counts: np.ndarray, budget: int, k: int) -> DataFrame:
    trees = len(forest.splits)
    budget = max(budget, 4 * trees * (k + 1))
    bits = min(forest.depth, max(0, int(np.ceil(np.log2(max(1, counts[0].sum() / CELL_ROWS))))))
    below = forest.depth - bits
    cells = counts.reshape(trees, 1 << bits, -1).sum(axis=2)
    chunks = np.maximum(1, -(-cells // CELL_ROWS))
    kind = indexed.schema["vector"].dataType.simpleString()
    schema = f"cell int, chunk int, query boolean, id long, vector {kind}, leaves array<int>"

    def rows_by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            leaves = np.asarray(batch["leaves"].flatten()).reshape(len(batch), trees)
            part = np.asarray(batch["part"])
            for tree in range(trees):
                cell = leaves[:, tree] >> below
                chunk = part % chunks[tree, cell]
                yield pa.RecordBatch.from_arrays([
                    pa.array(tree * (1 << bits) + cell, pa.int32()), pa.array(chunk, pa.int32()), pa.array(np.zeros(len(batch), bool)),
                    batch["id"], batch["vector"],
                    pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32)), pa.array(leaves[:, tree], pa.int32())),
                ], names=["cell", "chunk", "query", "id", "vector", "leaves"])

    def queries_by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = matrix(batch["vector"])
            for at in range(len(batch)):
                opened: dict[tuple[int, int], list[int]] = {}
                taken = 0
                for tree, leaf in forest.opened(wide[at]):
                    opened.setdefault((tree, leaf >> below), []).append(leaf)
                    taken += int(counts[tree, leaf])
                    if taken >= budget:
                        break
                listed = [(tree * (1 << bits) + cell, chunk, leaves)
                          for (tree, cell), leaves in opened.items() for chunk in range(chunks[tree, cell])]
                repeat = pa.array([at] * len(listed), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in listed], pa.int32()), pa.array([x[1] for x in listed], pa.int32()),
                    pa.array([True] * len(listed)), batch["id"].take(repeat), batch["vector"].take(repeat),
                    pa.array([x[2] for x in listed], pa.list_(pa.int32())),
                ], names=["cell", "chunk", "query", "id", "vector", "leaves"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell chunk come before the queries that opened leaves of it."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key, ready = None, None
        for batch in batches:
            out: list[tuple] = []
            for start, end, now, query in _runs(batch):
                part = batch.slice(start, end - start)
                if now != key:
                    key, held, ready = now, [], None
                if not query:
                    held.append((np.asarray(part["id"]), matrix(part["vector"]), np.asarray(part["leaves"].flatten())))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids, rows, leaves = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(leaves, kind="stable")
                    ready = ids[order], rows[order], leaves[order]
                ids, rows, leaves = ready
                wanted = matrix(part["vector"])
                for at, (own, opened) in enumerate(zip(part["id"].to_pylist(), part["leaves"].to_pylist())):
                    spots = np.array(opened)
                    low, high = np.searchsorted(leaves, spots), np.searchsorted(leaves, spots, side="right")
                    picked = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
                    near, score = nearest_of(rows[picked], ids[picked], wanted[at], own, k)
                    mark = zlib.crc32(wanted[at].tobytes())
                    out.extend((own, mark, int(i), float(s)) for i, s in zip(near, score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    names=["query_id", "mark", "id", "score"],
                )

    rows = indexed.filter(F.col("copy") <= k + 1).select(
        "id", "vector", "leaves", F.pmod(F.xxhash64("id", F.lit(SEED + 2)), F.lit(1 << 30)).alias("part")
    ).mapInArrow(rows_by_cell, schema)
    queries = indexed.filter(is_query).select("id", "vector").mapInArrow(queries_by_cell, schema)
    met = rows.unionByName(queries).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "query")
    near = met.mapInArrow(rerank, "query_id long, mark long, id long, score double").distinct()
    order = Window.partitionBy("query_id", "mark").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int], bool]]:
    """Stretches of a sorted batch with one cell, chunk and kind."""
    if not len(batch):
        return
    cell, chunk, query = (np.asarray(batch[name]) for name in ("cell", "chunk", "query"))
    change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0) | (query[1:] != query[:-1])) + 1
    edges = [0, *change.tolist(), len(batch)]
    for start, end in zip(edges, edges[1:]):
        yield start, end, (int(cell[start]), int(chunk[start])), bool(query[start])
