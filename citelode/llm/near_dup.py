"""Near duplicates: banded MinHash, odd sketches, exact confirmation.

Documents of one word sequence are one node. Nodes that agree in a band of MinHash values share
a bucket. In every bucket the node with the most company is the leader, and the
others are paired with it; pairs whose odd sketches differ too much for the threshold go, the
rest are confirmed on the full shingle sets. An odd sketch is a bitmap in which every
MinHash sample flips one bit, so the ones in the XOR of two sketches tell how many samples differ.

Leaders do not find every link. Buckets that still hold several components after the
leaders' links are known go through an exact second way: a prefix filter. With
shingles in one global order, rarest first, two sets that are similar enough share a
shingle among their first ones, at places that leave room for the overlap. Groups of such a
shingle are compared across components only, in blocks of bounded size, and the pairs
that the places allow are sketched and confirmed as before. So no group is ever spelled out as pairs:
a cluster of copies is a star, and what is left is compared where a link is possible.

A pair at the threshold shares no bucket with probability ``MISS`` at most, and an odd sketch
drops it with the probability of a deviation of ``DEVIATIONS`` standard errors.

What travels for the confirmation are word sequences, compressed, of the nodes that the pairs at hand
name; a task builds the sets of a pair from them. Sets of 64-bit hashes would be several times as long.

Defined cases: a null or empty text and one without words has an empty set, is linked with nothing
and is a component of its own. A text with fewer words than a shingle is one shingle. Rows
that repeat are copies of one node. The smallest id names a component, null ids aside; a component of
null ids only is named null. Other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import BlockedBloom, forget, one_of_each, portions, row_key, same, tidy, whole_text
from citelode.operators.sizing import lookup_join
from citelode.session import shared_table

MISS, DEVIATIONS = 1e-6, 6
ROWS = 5
SKETCH_BITS = 512
#: Counters of the order of shingles, and rows of a side of a compared block.
COUNTERS = 1 << 20
BLOCK = 4_096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """Words with A to Z lower-cased, and nothing else."""
    return text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``width`` words."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    span = min(n, width)
    out = np.full(n - span + 1, span, dtype=np.uint64)
    for at in range(span):
        out = out * _ODD + hashed[at : at + len(out)]
    return np.unique(_mixed(out))


@dataclass(frozen=True)
class Plan:
    """Sizes that follow from the shingle width and the similarity in percent."""

    width: int
    percent: int

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def samples(self) -> int:
        return self.bands * ROWS

    @property
    def most_ones(self) -> int:
        """Ones in the XOR of two sketches that the threshold still allows."""
        share = self.percent / 100
        differ = min(1.0, 1 - share + DEVIATIONS * math.sqrt(share * (1 - share) / self.samples))
        flips = 2 * self.samples * differ
        spread = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
        return math.ceil(spread + DEVIATIONS * math.sqrt(spread * spread / SKETCH_BITS) / 2)

    def least_overlap(self, both: Column) -> Column:
        """Common shingles that sets of ``both`` shingles together need."""
        return F.ceil(both * self.percent / (100 + self.percent))

    def similar(self, common: Column, left: Column, right: Column) -> Column:
        return 100 * common >= self.percent * (left + right - common)


def min_hashes(hashed: np.ndarray, samples: int) -> np.ndarray:
    seeds = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _ODD)
    least = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashed), 2048):
        spread = (hashed[at : at + 2048, None] ^ seeds[None, :]) * (seeds | np.uint64(1))[None, :]
        least = np.minimum(least, (spread ^ (spread >> np.uint64(32))).min(axis=0))
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit words."""
    places = _mixed(least + np.arange(1, len(least) + 1, dtype=np.uint64) * _ODD) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for at in range(ROWS):
        keys = keys * _ODD + rows[:, at]
    return _mixed(keys).view(np.int64)


_LONGS = T.ArrayType(T.LongType())
_SIGNATURE = T.StructType([
    T.StructField("n", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("sketch", _LONGS), T.StructField("bands", _LONGS),
])
_SIGNATURE_ARROW = pa.struct([
    ("n", pa.int32()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
])


def signature(plan: Plan, text: Column) -> Column:
    @F.arrow_udf(_SIGNATURE)
    @tidy
    def signed(texts: pa.Array) -> pa.Array:
        forget()
        out = []
        for start, end in portions(texts):
            for value in texts.slice(start, end - start).to_pylist():
                words = words_of(value)
                own = shingles(words, plan.width)
                least = min_hashes(own, plan.samples)
                out.append({
                    "n": len(own), "node": xxhash.xxh3_128_digest(b" ".join(words)),
                    "sketch": odd_sketch(least) if len(own) else [], "bands": band_keys(least) if len(own) else [],
                })
        return pa.array(out, type=_SIGNATURE_ARROW)

    return signed(text)


def packed_words(text: Column) -> Column:
    """The words of a text joined by spaces, compressed."""
    @F.arrow_udf(T.BinaryType())
    @tidy
    def packed(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3)
        return pa.array([squeeze.compress(b" ".join(words_of(value.as_py()))) for value in texts], type=pa.binary())

    return packed(text)


def _sets_of(packed: pa.Array, plan: Plan) -> Iterator[np.ndarray]:
    """Shingle sets of packed texts; a text that repeats in the next row is read once."""
    expand = zstandard.ZstdDecompressor()
    last, own = None, np.zeros(0, dtype=np.uint64)
    for value in packed:
        held = value.as_py()
        if held != last:
            last, own = held, shingles(expand.decompress(held).split(b" "), plan.width)
        yield own


def shingle_set(plan: Plan, packed: Column) -> Column:
    @F.arrow_udf(_LONGS)
    @tidy
    def sets(values: pa.Array) -> pa.Array:
        return pa.array([own.view(np.int64) for own in _sets_of(values, plan)], type=pa.list_(pa.int64()))

    return sets(packed)


_OVERLAP = T.StructType([T.StructField(name, T.LongType()) for name in ("common", "a", "b")])


def overlap(plan: Plan, left: Column, right: Column) -> Column:
    """``common, a, b``: shingles that two packed texts share, and the sizes of their sets."""

    @F.arrow_udf(_OVERLAP)
    @tidy
    def counted(some: pa.Array, others: pa.Array) -> pa.Array:
        counts = [
            (len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))
            for a, b in zip(_sets_of(some, plan), _sets_of(others, plan), strict=True)
        ]
        columns = np.array(counts, dtype=np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([pa.array(column) for column in columns], names=["common", "a", "b"])

    return counted(left, right)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of all nodes with an edge ``a, b``: the least node reachable.

    Labels go to the neighbours and then jump to the label of the label, so that long
    chains take few rounds. A node or label with very many neighbours is a key of lookups that
    broadcast what is small and salt what is not. Every round is written, which also cuts the lineage."""
    both = shared_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = shared_table(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("comp")), "labels")
    while True:
        near = lookup_join(both, labels.select(F.col("node").alias("b"), "comp"), ["b"]).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        moved = shared_table(moved, "labels")
        target = moved.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        jumped = lookup_join(moved, target, ["comp"], "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        jumped = shared_table(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.filter("comp <> old").isEmpty():
            return labels


def _among(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``packed`` that may belong to ``nodes``; others do not enter a shuffle."""
    keys = nodes.select(F.xxhash64("node").alias("key"))
    possible, _ = BlockedBloom.build(keys, "key").split(packed, F.xxhash64("node"))
    return possible


def _confirmed(pairs: DataFrame, nodes: DataFrame, packed: DataFrame, plan: Plan) -> DataFrame:
    """Pairs ``a, b`` that pass the odd sketches and then the comparison of full sets."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    differ = F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    pairs = pairs.filter(F.aggregate(differ, F.lit(0), lambda total, x: total + x) <= plan.most_ones).select("a", "b")
    pairs = shared_table(pairs, "sketched")
    ends = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    own = _among(packed, ends).dropDuplicates(["node"])
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")), side)
    found = pairs.select("a", "b", overlap(plan, F.col("words_a"), F.col("words_b")).alias("o"))
    return found.filter(plan.similar(F.col("o.common"), F.col("o.a"), F.col("o.b"))).select("a", "b")


_FIRST = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("tokens", _LONGS)])
_FIRST_ARROW = pa.struct([("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _prefixes(members: DataFrame, packed: DataFrame, plan: Plan) -> DataFrame:
    """``token, place, node, comp, n``: the first shingles of each member in the global order
    of (count, hash). The counts are a table of COUNTERS numbers, whatever the input."""
    own = _among(packed, members)
    slot = F.col("token").bitwiseAND(F.lit(COUNTERS - 1))
    tokens = own.select(F.explode(shingle_set(plan, F.col("words"))).alias("token"))
    seen = tokens.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()

    @F.arrow_udf(_FIRST)
    @tidy
    def first_ones(values: pa.Array) -> pa.Array:
        out = []
        for own in _sets_of(values, plan):
            tokens = own.view(np.int64)
            order = np.lexsort((tokens, counts[tokens & (COUNTERS - 1)]))
            n = len(tokens)
            out.append({"n": n, "tokens": tokens[order[: n - -(-n * plan.percent // 100) + 1]]})
        return pa.array(out, type=_FIRST_ARROW)

    firsts = own.select("node", first_ones("words").alias("f")).select("node", "f.*").dropDuplicates(["node"])
    return firsts.join(members, "node").select("node", "comp", "n", F.posexplode("tokens").alias("place", "token"))


_PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


def _possible_pairs(plan: Plan, few: Column, many: Column) -> Column:
    """Pairs across components whose places and sizes leave room for the overlap needed."""

    @F.arrow_udf(_PAIRS)
    @tidy
    def paired(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for some, others in zip(left, right, strict=True):
            a, b = some.values, others.values
            field = {name: (a.field(name), b.field(name)) for name in ("node", "comp", "n", "place")}
            n_a, n_b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in field["n"])
            at_a, at_b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in field["place"])
            names = {comp: i for i, comp in enumerate(dict.fromkeys([*field["comp"][0].to_pylist(), *field["comp"][1].to_pylist()]))}
            comp_a, comp_b = (np.array([names[comp] for comp in x.to_pylist()]) for x in field["comp"])
            found = []
            for i in range(len(n_a)):
                need = -(-(n_a[i] + n_b) * plan.percent // (100 + plan.percent))
                room = np.minimum(n_a[i] - at_a[i], n_b - at_b)
                found += [(i, j) for j in np.flatnonzero((room >= need) & (comp_b != comp_a[i])).tolist()]
            nodes_a, nodes_b = field["node"][0].to_pylist(), field["node"][1].to_pylist()
            out.append([{"a": min(nodes_a[i], nodes_b[j]), "b": max(nodes_a[i], nodes_b[j])} for i, j in found])
        return pa.array(out, type=pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))

    return paired(few, many)


def _rest(members: DataFrame, packed: DataFrame, plan: Plan) -> DataFrame:
    """Pairs ``a, b`` of different components that may be links, by the prefix filter."""
    rows = shared_table(_prefixes(members, packed, plan), "prefixes")
    split = (F.min("comp") != F.max("comp")).alias("split")
    room = F.col("n") - F.col("place")
    for _ in range(2):  # the second time without the rows that no size in the group leaves room for
        stats = rows.groupBy("token").agg(split, F.min("n").alias("least")).filter("split").select("token", "least")
        rows = rows.join(stats, "token").filter(room >= plan.least_overlap(F.col("n") + F.col("least"))).drop("least")
        rows = shared_table(rows, "prefixes")
    sizes = shared_table(rows.groupBy("comp").agg(F.countDistinct("node").alias("members")), "sizes")
    ranked = shared_table(lookup_join(rows, sizes, ["comp"]), "prefixes")
    main = F.max(F.struct("members", "comp"))
    groups = ranked.groupBy("token").agg(split, main.alias("main"), F.count("*").alias("all_rows")).filter("split")
    groups = shared_table(groups.select("token", F.col("main.comp").alias("main"), F.ceil(F.col("all_rows") / BLOCK).cast("int").alias("blocks")), "groups")
    placed = ranked.join(groups, "token")
    entry = F.struct("node", "comp", "n", "place")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Members outside a group's largest component meet all members, block by block.
    few = placed.filter("comp <> main").select("token", own.alias("i"), F.explode(every).alias("j"), entry.alias("entry"))
    few = few.groupBy("token", "i", "j").agg(F.collect_list("entry").alias("few"))
    many = placed.select("token", own.alias("j"), F.explode(every).alias("i"), entry.alias("entry"))
    many = many.groupBy("token", "i", "j").agg(F.collect_list("entry").alias("many"))
    return few.join(many, ["token", "i", "j"]).select(F.explode(_possible_pairs(plan, F.col("few"), F.col("many"))).alias("p")).select("p.*").distinct()


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, group_size, kept`` of every row."""
    plan = Plan(width, percent)
    raw = whole_text(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, raw).alias("row"), signature(plan, raw).alias("s"))
    rows = shared_table(rows.select("doc_id", "row", "s.*"), "signatures")
    first = F.min(F.struct("row"))["row"].alias("row")
    nodes = rows.filter("n > 0").groupBy("node").agg(first, F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = shared_table(nodes, "nodes")
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    full = shared_table(each.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "full")
    shared, _ = BlockedBloom.build(full, "bucket").split(each, F.col("bucket"))
    members = shared_table(lookup_join(shared, full, ["bucket"]), "members")
    company = shared_table(members.groupBy("node").agg(F.sum("size").alias("company")), "company")
    packed = _packed(docs, doc_id, text, nodes.join(company, "node").select("node", "row"))
    leaders = members.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node"))["node"].alias("leader"))
    stars = lookup_join(members, shared_table(leaders, "leaders"), ["bucket"]).filter("node <> leader")
    stars = stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    edges = shared_table(_confirmed(stars, nodes, packed, plan), "edges")
    known = components(edges)
    placed = members.select("bucket", "node").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = shared_table(placed, "placed")
    open_ = placed.groupBy("bucket").agg((F.min("comp") != F.max("comp")).alias("split")).filter("split").select("bucket")
    left = shared_table(placed.join(open_, "bucket").select("node", "comp").distinct(), "left")
    more = shared_table(_confirmed(_rest(left, packed, plan), nodes, packed, plan), "edges")
    if not more.isEmpty():
        known = components(edges.unionByName(more))
    comp = F.when(F.col("n") > 0, F.coalesce("comp", "node"))
    labelled = lookup_join(rows.select("doc_id", "row", "n", "node"), known, ["node"], "left")
    labelled = shared_table(labelled.select("doc_id", "row", "n", comp.alias("comp")), "labelled")
    names = labelled.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("name"), F.count("*").alias("size")).filter("size > 1")
    named = lookup_join(labelled, shared_table(names, "names"), ["comp"], "left")
    alone = F.col("size").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("name"))
    return named.select(
        "doc_id", "row", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), same(F.col("doc_id"), component).alias("kept"),
    )


def _packed(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``node, words`` of nodes that share a bucket; other texts are not read into Python again.
    Rows of one id and one text give a node several times."""
    wanted = shared_table(wanted, "wanted")
    raw = whole_text(text)
    rows = docs.select(row_key(doc_id, raw).alias("row"), raw.alias("text"))
    possible, _ = BlockedBloom.build(wanted, "row").split(rows, F.col("row"))
    packed = possible.select("row", packed_words(F.col("text")).alias("words"))
    return shared_table(lookup_join(packed, wanted, ["row"]).select("node", "words"), "packed")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, columns as they were."""
    judged = link(docs, doc_id, text, width, percent).filter("group_size > 1")
    judged = shared_table(judged.select(F.col("row").alias("key"), "kept"), "judged")
    return one_of_each(docs, row_key(doc_id, whole_text(text)), judged)
