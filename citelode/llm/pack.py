"""Packing along a space-filling curve.

Token ids are hashed into a fixed number of buckets, the bucket vector of a document is
projected to four dimensions, and the place on the Hilbert curve through that space orders
the documents: neighbours on the curve have similar words. Range-sorted stretches of the
curve are packed independently, each as one stream of tokens cut every ``length`` tokens.
The end of a stretch is cut into powers of two, which need no padding.

Defined cases: a null or empty text is the end token alone. Rows that repeat are packed
as often as they occur. Ties on the curve go by id, null last, and then by the tokens.
Empty input gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import forget, memory, portions, whole_text
from citelode.session import shared_table

LENGTH = 4096
END = 2
BUCKETS = 512
DIMENSIONS = 4
#: Bits per dimension; the curve key has DIMENSIONS times as many.
BITS = 12
#: Tokens in a stretch of the curve that one task packs.
STRETCH = 4_000_000
#: Words whose tokens each half of a worker's memory holds.
REMEMBERED = 400_000
#: Words of letters that are encoded as one text.
TOGETHER = 200
#: Marks that may follow a word.
MARKS = b",.;:!?%&$#*|)"

_TOKENIZED = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class WordTokens:
    """Tokens of texts through a memory of words already seen.

    The tokenizer's pattern never matches across white space and its normaliser works
    inside words, so the tokens of a text are those of its words in order. Words are
    encoded by the tokenizer itself, new ones of a batch at once. The memory has a young
    and an old half; when the young one is full it becomes the old one, so frequent words stay."""

    _known: dict[str, WordTokens] = memory()

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        # One task, one core: Spark runs the tasks beside each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer, self._plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._plain.normalizer, self._plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self._tokenizer.get_vocab()
        #: Whether the token of an id ends a match of the pattern.
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> WordTokens:
        """The one of this worker, which keeps its memory from task to task."""
        if path not in cls._known:
            forget()
            cls._known[path] = cls(path)
        cls._known[path].remembered = remembered
        return cls._known[path]

    def _encode_new(self, words: list[bytes]) -> None:
        """Put words that neither half has into the young half. A word of letters alone is one match of the pattern, whose last token has the
        end-of-word mark, so such words are encoded as one text and cut behind the marks. Every word has one mark at
        least: if there are as many marks as words, the cuts are right, and if not, the words go one by one.
        Lower-case ASCII letters are left alone by the normaliser, and white space alone cuts them."""
        letters = [word for word in words if word.isalpha() and word.islower()]
        others = list(set(words).difference(letters))
        foreign, single = [], []
        for word in others:
            (foreign if word.decode().isalpha() else single).append(word)
        for tokenizer, own in ((self._plain, letters), (self._tokenizer, foreign)):
            groups = [own[at : at + TOGETHER] for at in range(0, len(own), TOGETHER)]
            joined = tokenizer.encode_batch_fast([b" ".join(group).decode() for group in groups], add_special_tokens=False)
            for group, one in zip(groups, joined, strict=True):
                ids = np.array(one.ids, dtype=self.dtype)
                ends = np.flatnonzero(self._ends[ids]) + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    single += group
                    continue
                data, cuts = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
                self._young.update(zip(group, [data[start:stop] for start, stop in pairwise(cuts)], strict=True))
        for word, one in zip(single, self._tokenizer.encode_batch_fast([word.decode() for word in single], add_special_tokens=False), strict=True):
            self._young[word] = np.array(one.ids, dtype=self.dtype).tobytes()

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """Take words from the old half to the young one; the others are returned."""
        fresh = words.difference(self._old)
        for word in words.difference(fresh):
            self._young[word] = self._old[word]
        return fresh

    def _learn(self, words: set[bytes]) -> None:
        """Put the tokens of all ``words`` into the young half. The pattern always cuts
        between an ASCII letter or digit and a mark that is no apostrophe, so a word and the
        marks after it are encoded apart."""
        young, whole, shorts, marks = self._young, [], [], []
        wanted = self._recall(words)
        for word in wanted:
            if word[-1] in MARKS and (short := word.rstrip(MARKS))[-1:].isalnum() and b"<|" not in word:
                whole.append(word)
                shorts.append(short)
                marks.append(word[len(short) :])
        wanted = wanted.difference(whole)
        wanted.update(self._recall(set(shorts).union(marks).difference(young)))
        wanted = list(wanted)
        for at in range(0, len(wanted), 20_000):
            self._encode_new(wanted[at : at + 20_000])
        for word, short, mark in zip(whole, shorts, marks, strict=True):
            young[word] = young[short] + young[mark]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        if len(self._young) > self.remembered:
            self._young, self._old = {}, self._young
        # The tokenizer lower-cases; ASCII letters can be lower-cased before, but not in its special strings.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        missing = set().union(*split).difference(self._young)
        if missing:
            self._learn(missing)
        known = self._young.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), dtype=self.dtype) for words in split]


def projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


def hashed_point(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The document's place in DIMENSIONS integer coordinates of BITS bits."""
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    counts = np.sqrt(np.bincount(spread.astype(np.int64), minlength=BUCKETS))
    norm = math.sqrt(float(counts @ counts)) or 1.0
    inside = np.arctan(counts @ matrix / norm * 2) / math.pi + 0.5
    return np.minimum((inside * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points, one row each.

    Coordinates become the curve's transposed index by undoing, from the high bit down,
    the reflections and exchanges of the sub-cubes; Gray decoding and interleaving give
    the key."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            set_ = (x[:, i] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, curve, doc_tokens, ids``; ids are little-endian unsigned numbers of two or
    four bytes, by the size of the vocabulary. A worker that has little room may remember fewer words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, matrix = WordTokens.of(tokenizer, remembered), projection()
        end = np.array([END], dtype=tokens.dtype)
        for whole in batches:
            for start, stop in portions(whole.column("text")):
                batch = whole.slice(start, stop - start)
                ids = [np.concatenate([one, end]) for one in tokens.encode(batch.column("text").cast(pa.binary()).to_pylist())]
                curve = hilbert_keys(np.stack([hashed_point(one, matrix) for one in ids]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(curve), pa.array([len(one) for one in ids], pa.int64()),
                     pa.array([one.tobytes() for one in ids], pa.binary())],
                    schema=_TOKENIZED,
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(work, "doc_id long, curve long, doc_tokens long, ids binary")


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def _tail(tokens: int) -> list[int]:
    """Powers of two that add up to ``tokens``, largest first."""
    return [1 << bit for bit in range(tokens.bit_length() - 1, -1, -1) if tokens >> bit & 1]


def lay_out(batches: Iterator[pa.RecordBatch], first: int, tokens: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one stretch, given how many tokens the stretch has.

    Whole sequences come first, so the cuts are known from the total: every ``length``
    tokens, then powers of two."""
    full = tokens // length
    tail = _tail(tokens - full * length)
    ends = full * length + np.cumsum([0, *tail])
    done = 0
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        rows: list[tuple] = []
        for doc, size, data in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "doc_tokens", "ids")), strict=True):
            data = np.frombuffer(data, dtype=f"<u{len(data) // size}").astype("<u4").tobytes()
            start = 0
            while start < size:
                if done < full * length:
                    sequence, offset = divmod(done, length)
                    room = length - offset
                else:
                    k = int(np.searchsorted(ends, done, "right")) - 1
                    sequence, offset, room = full + k, done - int(ends[k]), int(ends[k + 1]) - done
                take = min(room, size - start)
                rows.append((doc, start, take, size, first + sequence, offset, data[4 * start : 4 * (start + take)]))
                start += take
                done += take
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, remembered: int = REMEMBERED
) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    The tokens are written once and then range-partitioned by (curve, id), so a group of
    copies with one curve key is still spread by id."""
    rows = shared_table(tokenized(docs, tokenizer, doc_id, text, remembered), "tokens")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    order = [F.col("curve"), F.col("doc_id").asc_nulls_last(), F.crc32("ids")]
    stretches = rows.repartitionByRange(max(1, math.ceil(total / STRETCH)), *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)  # about STRETCH tokens, 8 MB, or one document if that is longer
        tokens = sum(int(np.sum(batch.column("doc_tokens").to_numpy())) for batch in held)
        yield from lay_out(iter(held), TaskContext.get().partitionId() << 40, tokens, length)

    return stretches.mapInArrow(
        work, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
