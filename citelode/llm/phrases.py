"""Phrase collocations from weighted acyclic automata.

A task counts the word sequences of its share of the texts and builds from the sorted sequences
an automaton whose arcs carry words and counts: a sequence keeps the states of the one before it as
far as their words agree. Automata are cut by ranges of the first two words and travel to the task
of their range, which unites them and sums the weights. The frequent sequences form one automaton
per range again, and the parts of a candidate are looked up by walking it.

Counting goes by length: words, then pairs, then longer sequences. A sequence is at most as
frequent as its parts, so texts are broken at words, and later at pairs, that are certainly rarer
than ``least``. A blocked Bloom filter of at most ``FILTER_WORDS`` words tells which; what it lets
through by mistake is counted and dropped, so results do not depend on it.

Defined cases: null texts are empty, a null language is ``und``. Repeated rows count each time. Texts
without words and tables without rows give no phrases; extra columns are ignored. A long text is
one share of its own, read whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelode.llm.common import BlockedBloom, give_back, portions
from citelode.session import shared_table

LONGEST, LEAST, FIRST = 5, 100, 2_000
#: Bytes of text that a task counts before it hands on automata, bytes of text for each range, and
#: sequences that a union holds before it sums them.
SHARD_BYTES, RANGE_BYTES, HELD_ROWS = 20_000_000, 24_000_000, 2_000_000
#: Documents and pairs of each that the ranges are cut by; results do not depend on them.
CUT_DOCS, CUT_PAIRS = 2_000, 50
#: A-Z lowered, every border of a piece a full stop.
PLAIN = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAKS = ("", ".")

SHIPPED = "part int, lang string, total long, words array<string>, sources array<array<int>>, labels array<array<int>>, counts array<array<long>>"
FREQUENT = "lang string, phrase string, size int, f long, hash long"


@dataclass
class Automaton:
    """Arcs by level, in the order of the sequences. An arc leaves the state behind an arc of the
    level before (``sources``), reads ``words[label]``, and carries the count of the sequence that ends
    with it (0: none ends there)."""

    words: list[str] | pa.Array  # as they came, until they are united
    sources: list[np.ndarray]
    labels: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of_sorted(cls, words: list[str], rows: np.ndarray, counts: np.ndarray) -> Automaton:
        """From different sequences in order: word numbers, filled up with -1."""
        used = np.unique(rows[rows >= 0])
        sources, labels, weights = [], [], []
        fresh = np.zeros(len(rows), dtype=bool)
        fresh[:1] = True
        before = np.zeros(len(rows), dtype=np.int32)
        lengths = (rows >= 0).sum(axis=1)
        for level in range(rows.shape[1]):
            fresh[1:] |= rows[1:, level] != rows[:-1, level]
            opens = fresh & (rows[:, level] >= 0)
            sources.append(before[opens])
            labels.append(np.searchsorted(used, rows[opens, level]).astype(np.int32))
            weights.append(np.where(lengths[opens] == level + 1, counts[opens], 0))
            before = np.cumsum(opens, dtype=np.int32) - 1
        return cls([words[i] for i in used.tolist()], sources, labels, weights)

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequences with a count, and the counts."""
        depth = len(self.labels)
        path = np.empty((1, 0), dtype=np.int32)
        ends = [np.flatnonzero(counts) for counts in self.counts]
        rows, start = np.full((sum(map(len, ends)), depth), -1, dtype=np.int32), 0
        for level in range(depth):
            path = np.column_stack([path[self.sources[level]], self.labels[level]])
            rows[start:start + len(ends[level]), :level + 1] = path[ends[level]]
            start += len(ends[level])
        return rows, np.concatenate([np.empty(0, dtype=np.int64), *(counts[at] for counts, at in zip(self.counts, ends))])

    def lookup(self, sequences: list[list[str]]) -> list[int]:
        """Count of each sequence, 0 where it does not end in the automaton."""
        number = {word: i for i, word in enumerate(self.words)}
        arcs = [dict(zip(zip(s.tolist(), w.tolist()), range(len(s)))) for s, w in zip(self.sources, self.labels)]
        out = []
        for sequence in sequences:
            state: int | None = 0
            for level, word in enumerate(sequence):
                state = arcs[level].get((state, number.get(word, -1))) if level < len(arcs) else None
                if state is None:
                    break
            out.append(0 if state is None else int(self.counts[len(sequence) - 1][state]))
        return out


def _large(words: list[str] | pa.Array) -> pa.Array:
    return words.cast(pa.large_string()) if isinstance(words, pa.Array) else pa.array(words, pa.large_string())


def union(automata: list[Automaton]) -> Automaton:
    """One automaton with the sequences of all, their counts summed."""
    depth = max(len(a.labels) for a in automata)
    names = pa.concat_arrays([_large(a.words) for a in automata]).dictionary_encode()
    order = pc.sort_indices(names.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[np.asarray(order)] = np.arange(len(order))
    number = rank[np.asarray(names.indices)]
    size = sum(int(np.count_nonzero(level)) for automaton in automata for level in automaton.counts)
    rows, counts = np.full((size, depth), -1, dtype=np.int32), np.empty(size, dtype=np.int64)
    start, at = 0, 0
    for automaton in automata:
        own = np.append(number[start:start + len(automaton.words)], np.int32(-1))  # -1 stays -1
        start += len(automaton.words)
        found, count = automaton.sequences()
        rows[at:at + len(found), :found.shape[1]] = own[found]
        counts[at:at + len(found)] = count
        at += len(found)
    rows, counts = _summed(rows, counts)
    return Automaton.of_sorted(names.dictionary.take(order).to_pylist(), rows, counts)


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.empty(0, dtype=np.int64)
    return rows[starts], np.add.reduceat(counts, starts) if len(rows) else counts


@dataclass(frozen=True)
class Filter:
    """The words of a ``BlockedBloom`` for whole arrays of hashes."""

    words: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        return cls(np.array(BlockedBloom.build(keys, "hash").stored.first()["words"], dtype=np.int64).view(np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(hashes), dtype=np.uint64)
        for shift in (40, 46, 52, 58):
            mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return self.words[(hashes & np.uint64(len(self.words) - 1)).astype(np.int64)] & mask == mask


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(word, seed) for word in words], dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(31)) | (second >> np.uint64(33)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words and breaks of lowered texts in one array, and the end of every text in it."""
    spaced = pc.replace_substring(texts, ".", " . ")
    listed = pc.ascii_split_whitespace(spaced)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(listed), 0)))
    return listed.flatten(), ends


def lowered(texts: pa.Array) -> pa.Array:
    """Every byte by ``PLAIN``; the lengths stay, so the offsets do too."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    if data is None:
        return whole
    return pa.LargeStringArray.from_buffers(len(whole), offsets, pa.py_buffer(data.to_pybytes().translate(PLAIN)), None, 0, whole.offset)


@dataclass(frozen=True)
class Ranges:
    """Cuts (lang, first word, second word) between the ranges, in order."""

    cuts: tuple[tuple[str, str, str], ...]

    def of(self, lang: str, sequence: list[str]) -> int:
        return bisect_right(self.cuts, (lang, *[*sequence, "", ""][:2]))

    def parts(self, lang: str, words: list[str], rows: np.ndarray) -> np.ndarray:
        """Range of each sequence of word numbers; ``words`` is sorted."""
        low, high = bisect_left(self.cuts, (lang, "", "")), bisect_left(self.cuts, (lang + "\0", "", ""))
        wide = len(words) + 1
        edges = []
        for _, first, second in self.cuts[low:high]:
            at = bisect_left(words, first)
            held = at < len(words) and words[at] == first
            edges.append(at * wide + (bisect_left(words, second) + 1 if held else 0))
        second = rows[:, 1] + 1 if rows.shape[1] > 1 else 0
        return low + np.searchsorted(np.array(edges, dtype=np.int64), rows[:, 0] * np.int64(wide) + second, side="right")


def count_words(texts: pa.Array, lang: str, level: int, words: Filter | None, pairs: Filter | None) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Sorted words, the different sequences of word numbers with their counts, and the number of
    words. Level 1: words, 2: pairs, 3: sequences of three to ``LONGEST``."""
    listed, ends = tokens(texts)
    coded = listed.dictionary_encode()
    del listed  # as large as the texts
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[np.asarray(order)] = np.arange(len(order))
    names = coded.dictionary.take(order).to_pylist()
    place = rank[np.asarray(coded.indices)]
    del coded
    known = np.ones(len(names), dtype=bool)
    for mark in BREAKS:
        at = bisect_left(names, mark)
        if at < len(names) and names[at] == mark:
            known[at] = False
    if level == 1:
        counts = np.bincount(place, minlength=len(names))
        counts[~known] = 0
        held = np.flatnonzero(counts)
        return names, held[:, None], counts[held], int(counts.sum())
    hashes = word_hashes(lang, names)
    known &= words.holds(hashes)
    place[~known[place]] = -1
    wide = len(names)
    joined = (place[:-1] >= 0) & (place[1:] >= 0)
    borders = ends[ends > 0] - 1
    joined[borders[borders < len(joined)]] = False
    at = np.flatnonzero(joined)
    keys = place[at] * np.int64(wide) + place[at + 1]
    if level == 2:
        found, counts = np.unique(keys, return_counts=True)
        return names, np.column_stack([found // max(1, wide), found % max(1, wide)]), counts, 0
    found, inverse = np.unique(keys, return_inverse=True)
    frequent = pairs.holds(pair_hashes(hashes[found // max(1, wide)], hashes[found % max(1, wide)])) if len(found) else np.empty(0, dtype=bool)
    pair = np.full(len(place), -1, dtype=np.int32)
    pair[at] = np.where(frequent[inverse], inverse, -1)
    del at, joined, keys, found, inverse
    now, rows, totals = pair, [np.empty((0, LONGEST), dtype=np.int32)], [np.empty(0, dtype=np.int64)]
    for size in range(3, LONGEST + 1):
        at = np.flatnonzero((now[:len(now) - size + 2] >= 0) & (pair[size - 2:] >= 0)) if len(now) >= size else np.empty(0, dtype=np.int64)
        first, inverse, counts = _told_apart(now[at] * np.int64(wide) + place[at + size - 1])
        words_of = np.full((len(first), LONGEST), -1, dtype=np.int32)
        for ahead in range(size):
            words_of[:, ahead] = place[at[first] + ahead]
        rows.append(words_of)
        totals.append(counts)
        now = np.full(len(place), -1, dtype=np.int32)
        now[at] = inverse
    return names, np.concatenate(rows), np.concatenate(totals), 0


def _told_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of every different key, each key's number among them, and the counts."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    numbers = np.empty(len(keys), dtype=np.int32)
    numbers[order] = np.repeat(np.arange(len(starts), dtype=np.int32), counts)
    return order[starts], numbers, counts


def _shipped(automata: list[tuple[int, str, int, Automaton]]) -> pa.RecordBatch:
    nested, longs = pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([
        pa.array([x[0] for x in automata], pa.int32()), pa.array([x[1] for x in automata]), pa.array([x[2] for x in automata], pa.int64()),
        pa.array([x[3].words for x in automata], pa.list_(pa.string())), pa.array([x[3].sources for x in automata], nested),
        pa.array([x[3].labels for x in automata], nested), pa.array([x[3].counts for x in automata], longs),
    ], names=["part", "lang", "total", "words", "sources", "labels", "counts"])


def _shard(texts: pa.Array, lang: str, level: int, words: Filter | None, pairs: Filter | None, ranges: Ranges) -> Iterator[tuple[int, str, int, Automaton]]:
    names, rows, counts, total = count_words(texts, lang, level, words, pairs)
    if not len(rows):
        return
    parts = ranges.parts(lang, names, rows)
    order = np.lexsort((*rows.T[::-1], parts))
    rows, counts, parts = rows[order], counts[order], parts[order]
    edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    for start, end in zip(edges, np.append(edges[1:], len(parts))):
        yield int(parts[start]), lang, total, Automaton.of_sorted(names, rows[start:end], counts[start:end])
        total = 0  # once for the share


def frequent(texts: DataFrame, level: int, least: int, ranges: Ranges, words: Filter | None = None, pairs: Filter | None = None) -> DataFrame:
    """Sequences of a level in at least ``least`` places: ``lang, phrase, size, f, hash``. Size 0: all words
    of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size = 0
        for batch in batches:
            plain, langs = lowered(batch["text"]), pc.fill_null(batch["lang"], "und")
            for start, end in portions(plain, SHARD_BYTES // 8, 1 << 30):
                some, of = plain.slice(start, end - start), langs.slice(start, end - start)
                for lang in pc.unique(of).to_pylist():
                    held.setdefault(lang, []).append(some.filter(pc.equal(of, lang)))
                size += pc.sum(pc.binary_length(some)).as_py()
                if size >= SHARD_BYTES:
                    for lang, arrays in held.items():
                        for one in _shard(pa.concat_arrays(arrays), lang, level, words, pairs, ranges):
                            yield _shipped([one])
                    held, size = {}, 0
        for lang, arrays in held.items():
            for one in _shard(pa.concat_arrays(arrays), lang, level, words, pairs, ranges):
                yield _shipped([one])
        del held
        give_back()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Automaton]] = {}
        totals: dict[str, int] = {}
        size = 0
        for batch in batches:
            for at in range(len(batch)):
                lang = batch["lang"][at].as_py()
                levels = [[np.asarray(level) for level in _inner(batch[name], at)] for name in ("sources", "labels", "counts")]
                held.setdefault(lang, []).append(Automaton(batch["words"][at].values, *levels))
                totals[lang] = totals.get(lang, 0) + batch["total"][at].as_py()
                size += sum(len(level) for level in levels[1])
                if size > HELD_ROWS:
                    held = {lang: [union(automata)] for lang, automata in held.items()}
                    size = max(0, sum(len(level) for (one,) in held.values() for level in one.labels) - HELD_ROWS // 2)
        for lang in sorted(held):
            yield _frequent(lang, union(held.pop(lang)), totals[lang], least)
        give_back()

    # a range is a task, so nothing is sorted and a task never holds several ranges
    shares = texts.mapInArrow(count, SHIPPED)
    return shares.repartitionById(len(ranges.cuts) + 1, F.col("part")).mapInArrow(unite, FREQUENT)


def _inner(column: pa.Array, at: int) -> list[pa.Array]:
    levels = column[at].values
    return [levels[i].values for i in range(len(levels))]


def _frequent(lang: str, automaton: Automaton, total: int, least: int) -> pa.RecordBatch:
    rows, counts = automaton.sequences()
    kept = counts >= least
    rows, counts = rows[kept], counts[kept].tolist()
    listed = [[automaton.words[i] for i in row if i >= 0] for row in rows.tolist()]
    hashes = [np.zeros(len(listed), dtype=np.uint64)] * 2
    if listed:
        hashes = [word_hashes(lang, [x[0] for x in listed]), word_hashes(lang, [x[1] if len(x) > 1 else "" for x in listed])]
    sizes = np.array([len(x) for x in listed], dtype=np.int64)
    hashed = np.where(sizes == 1, hashes[0], pair_hashes(*hashes)).view(np.int64)
    lines = [(lang, " ".join(x), len(x), f, int(h)) for x, f, h in zip(listed, counts, hashed)]
    if total:
        lines.append((lang, "", 0, total, 0))
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in lines], type_) for i, type_ in enumerate(types)], names=["lang", "phrase", "size", "f", "hash"]
    )


def cut_ranges(texts: DataFrame) -> Ranges:
    """Cuts at equal shares of sampled pairs; a range stands for ``RANGE_BYTES`` of text."""
    size = texts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    wanted = -(-size["bytes"] // RANGE_BYTES)
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    some = texts.filter(part < int(min(1.0, CUT_DOCS / max(1, size["docs"])) * (1 << 30)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, langs = lowered(batch["text"]), pc.fill_null(batch["lang"], "und").to_pylist()
            for at, lang in enumerate(langs):
                listed = tokens(plain.slice(at, 1))[0]
                step = max(1, len(listed) // CUT_PAIRS)
                some = listed.slice(0, len(listed) // step * step).to_pylist()
                found = [(lang, *some[i:i + 2]) for i in range(0, len(some) - 1, step)]
                found = [x for x in found if not set(BREAKS) & set(x[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["lang", "first", "second"])

    sample = sorted(tuple(row) for row in some.mapInArrow(pairs, "lang string, first string, second string").limit(2 * CUT_DOCS * CUT_PAIRS).collect())
    cuts = {sample[i * len(sample) // wanted] for i in range(1, wanted)} if sample else set()
    return Ranges(tuple(sorted(cuts)))


def part_counts(frequent_: DataFrame, candidates: DataFrame, ranges: Ranges) -> DataFrame:
    """Counts of the two parts of every cut: ``lang, phrase, a, cut, l, r``. The automata of the
    ranges are built from the sorted sequences and answer the requests of their range."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.slice(words, 1, F.col("cut")).alias("sequence")),
        F.struct(F.lit("r").alias("side"), F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")).alias("sequence")),
    ))
    asked = cuts.select("lang", "phrase", F.col("f"), "cut", sides.alias("x")).select("lang", "phrase", "f", "cut", "x.side", "x.sequence")
    arcs = frequent_.filter("size > 0").select("lang", "phrase", "f", F.lit(0).alias("cut"), F.lit("").alias("side"), words.alias("sequence"))
    schema = "part int, lang string, phrase string, f long, cut int, side string, sequence array<string>"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranges.of(lang, sequence) for lang, sequence in zip(batch["lang"].to_pylist(), batch["sequence"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, automaton = None, [], None
        for batch in batches:
            names = ("part", "lang", "phrase", "f", "cut", "side", "sequence")
            rows = list(zip(*(batch[name].to_pylist() for name in names)))
            asked: dict[tuple, list[tuple]] = {}
            out = []
            for row in rows:
                if row[:2] != key:
                    out += _answers(automaton, known, asked.pop("now", []))
                    key, known, automaton = row[:2], [], None
                if row[4] == 0:
                    known.append((row[6], row[3]))
                else:
                    asked.setdefault("now", []).append(row)
            if asked.get("now"):
                automaton = automaton or _built(known)
                out += _answers(automaton, known, asked["now"])
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], type_) for i, type_ in enumerate(types)], names=["lang", "phrase", "f", "cut", "side", "count"]
            )

    met = arcs.unionByName(asked).mapInArrow(locate, schema)
    ordered = met.repartition("part").sortWithinPartitions("part", "lang", "cut", "sequence")
    found = ordered.mapInArrow(answer, "lang string, phrase string, f long, cut int, side string, count long")
    return found.groupBy("lang", "phrase", F.col("f").alias("a"), "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("count"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("count"))).alias("r")
    )


def _built(known: list[tuple[list[str], int]]) -> Automaton:
    words = sorted({word for sequence, _ in known for word in sequence})
    number = {word: i for i, word in enumerate(words)}
    rows = np.full((len(known), LONGEST), -1)
    for at, (sequence, _) in enumerate(known):
        rows[at, :len(sequence)] = [number[word] for word in sequence]
    return Automaton.of_sorted(words, rows, np.array([count for _, count in known], dtype=np.int64))


def _answers(automaton: Automaton | None, known: list, asked: list[tuple]) -> list[tuple]:
    if not asked:
        return []
    counts = (automaton or _built(known)).lookup([row[6] for row in asked])
    return [(*row[1:6], count) for row, count in zip(asked, counts)]


def scored(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every candidate: ``lang, phrase, a, l, r, n, score``."""
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"({wide.format('1000 * a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    ranked = cuts.join(totals, "lang").withColumn("score", score)
    lowest = ranked.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return lowest.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, percent: int = 100) -> DataFrame:
    """Each language's ``first`` phrases by score: ``lang, rank, phrase, a, l, r, n, score``. A phrase goes if
    a longer candidate around it has ``percent`` of its count."""
    texts = docs.select("text", "lang")
    ranges = cut_ranges(texts)
    singles = shared_table(frequent(texts, 1, least, ranges), "words")
    words = Filter.of(singles.filter("size = 1"))
    pairs = shared_table(frequent(texts, 2, least, ranges, words), "pairs")
    both = Filter.of(pairs)
    longer = shared_table(frequent(texts, 3, least, ranges, words, both), "longer")
    known = singles.unionByName(pairs).unionByName(longer)
    candidates = pairs.unionByName(longer)
    totals = singles.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))

    split = F.split("phrase", " ")
    inner = longer.select("lang", F.col("f").alias("around"), F.explode(F.array(
        F.array_join(F.slice(split, 1, F.col("size") - 1), " "), F.array_join(F.slice(split, 2, F.col("size") - 1), " ")
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("f")))
    best = scored(part_counts(known, kept.select("lang", "phrase", "size", "f"), ranges), totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
spots AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS spot FROM listed WHERE len(words) > 0),
grams AS (
  SELECT lang, size, array_to_string(words[spot:spot + size - 1], ' ') AS phrase, count(*) AS f
  FROM spots, generate_series(1, 5) AS s(size) WHERE spot + size - 1 <= len(words) GROUP BY ALL),
known AS (SELECT * FROM grams WHERE f >= 100),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f FROM known WHERE size >= 2),
inner_parts AS (
  SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(f) AS around
  FROM candidates, generate_series(2, 4) AS k(k), generate_series(1, 4) AS i(i) WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.around IS NULL OR 100 * p.around < 100 * c.f),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(words[:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM kept, generate_series(1, 4) AS k(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.head
    JOIN known y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
