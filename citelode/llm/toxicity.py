"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

Strings are compared by their common subsequences of three characters; a subsequence
counts less the more it is stretched, so an insult with gaps or inserted characters stays
close to the plain one. Landmark strings span the feature space (Nyström): a string is
its kernel values against the landmarks, whitened by the landmarks' own kernel matrix,
and a linear support vector machine lives there.

Training reads a bounded sample of labelled documents, cut into sentences. A word that
toxic sentences have in many different surroundings and clean ones hardly have becomes
landmark and positive example, every such word; near copies of one document add no new surroundings. The
other words of clean sentences, the ones closest to the positives among them, are the negatives, and the
closest of all are landmarks as well. A document scores as its
worst string, mapped to (0, 1) by a logistic curve fitted to the sampled documents.

Defined cases: a null or empty text scores as a text whose strings are far from all
landmarks. Without toxic training rows (an empty label table too) every score is 0. Labels
of one document that differ, or that repeat, count as toxic if one of them is; null labels and ids are
not used. A string longer than ``PIECE`` characters is read as overlapping pieces, all of it. A run
of single characters ("i d i o t") is read as one string too. Other columns are never read.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import BLANKS, WORD, forget, memory, portions, whole_text
from citelode.session import shared_table

#: Labelled documents the classifier is fitted on, at most, of each label.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
#: Clean words used as negatives (drawn, closest).
NEGATIVES, CLOSE = 8_000, 4_000
#: The closest of them that are landmarks too, so that a word and its clean relatives can be told apart.
CLEAN_LANDMARKS = 200
#: Chance, over the whole vocabulary, that some word is a landmark by accident.
ACCIDENT = 0.01
ORDER, DECAY = 3, 0.6
PIECE = 24
#: Subsequences that are looked up in a plain table, and numbers that are worked on at once.
DENSE, AT_ONCE = 1 << 20, 1 << 20
#: Words and strings whose score each half of a worker's memory holds.
REMEMBERED = 100_000
#: Bytes of text that are scored at once; their new words come on top of the memory.
PORTION = 1_000_000
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’¡¿…–—"


def _codes(strings: list[str]) -> np.ndarray:
    width = max(map(len, strings), default=1) or 1
    flat = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).reshape(len(strings), width)


def _subsequences(agree: np.ndarray) -> np.ndarray:
    """Kernel of ORDER-character subsequences for stacked pairs. ``agree[a, b]`` says for every
    pair where character a of the left and b of the right string are the same."""
    square, decay = np.float32(DECAY * DECAY), np.float32(DECAY)
    hits = agree * square
    for _ in range(ORDER - 1):
        # Longer subsequences end in a hit behind a shorter one: those are summed over all
        # places before, each step away costing one more decay.
        reach = np.zeros_like(hits)
        for b in range(1, hits.shape[1]):
            reach[:, b] = decay * reach[:, b - 1] + hits[:, b - 1]
        for a in range(1, hits.shape[0]):
            reach[a] += decay * reach[a - 1]
        hits[1:] = agree[1:] * square * reach[:-1]
        hits[0] = 0
    return hits.sum(axis=(0, 1))


@lru_cache(maxsize=64)
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of every subsequence of ORDER characters in ``width``, and what its stretch leaves of it."""
    places = np.array(list(combinations(range(width), ORDER)), dtype=np.intp).reshape(-1, ORDER).T
    return places, np.float32(DECAY) ** (places[-1] - places[0] + 1).astype(np.float32)


class Spelling:
    """Landmarks written out as their subsequences, so that a string is read once for all of them.

    The kernel is a product of two vectors over subsequences. Any weighted sum over landmarks is
    therefore one number a subsequence, and costs the same for two landmarks or two thousand.
    ``columns`` has a row for each landmark and a column for each sum wanted."""

    def __init__(self, landmarks: list[str], columns: np.ndarray):
        codes = _codes(landmarks).T
        self.alphabet = np.setdiff1d(codes, [0])
        letters = self._letters(codes)
        places, fade = _places(len(letters))
        used = (letters[places] > 0).all(axis=0)
        self.keys, row = np.unique(self._keys(letters, places)[used], return_inverse=True)
        at, landmark = np.nonzero(used)
        share = fade[at] / np.sqrt(np.maximum(_self_values(landmarks), 1e-12))[landmark]
        #: The last row is that of subsequences no landmark has.
        self.sums = np.zeros((len(self.keys) + 1, columns.shape[1]), dtype=np.float32)
        np.add.at(self.sums, row.reshape(-1), share[:, None] * columns[landmark].astype(np.float32))
        self.slots = None
        if (len(self.alphabet) + 1) ** ORDER <= DENSE:
            self.slots = np.full((len(self.alphabet) + 1) ** ORDER, len(self.keys), dtype=np.int32)
            self.slots[self.keys] = np.arange(len(self.keys))

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Places in the alphabet from 1; 0 for characters that no landmark has."""
        if not len(self.alphabet):
            return np.zeros(codes.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def _keys(self, letters: np.ndarray, places: np.ndarray) -> np.ndarray:
        keys = letters[places[0]]
        for more in places[1:]:
            keys = keys * (len(self.alphabet) + 1) + letters[more]
        return keys

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        if self.slots is not None:
            return self.slots[keys]
        if not len(self.keys):
            return np.zeros(keys.shape, dtype=np.intp)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))

    def values(self, strings: list[str]) -> np.ndarray:
        """The sums of each string: its normalised kernel with every landmark, times ``columns``."""
        out = np.zeros((len(strings), self.sums.shape[1]), dtype=np.float32)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        at = 0
        while at < len(order):
            places, fade = _places(len(strings[order[at]]))
            some = order[at : at + max(1, min(1024, AT_ONCE // max(1, len(fade) * out.shape[1])))]
            at += len(some)
            if not len(fade):
                continue
            words = [strings[i] for i in some]
            rows = self._rows(self._keys(self._letters(_codes(words).T), places))
            own = np.sqrt(np.maximum(_self_values(words), 1e-12))
            out[some] = np.einsum("t,tnm->nm", fade, self.sums[rows]) / own[:, None]
        return out


def kernel_values(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each string with each landmark."""
    blocks = [landmarks[at : at + 64] for at in range(0, len(landmarks), 64)]
    return np.hstack([Spelling(block, np.eye(len(block))).values(strings) for block in blocks])


def _self_values(strings: list[str]) -> np.ndarray:
    codes = _codes(strings).T
    return _subsequences((codes[:, None, :] == codes[None, :, :]) & (codes != 0)[None, :, :])


def pieces_of(word: bytes) -> list[str]:
    """The strings a word is read as: lower case, without punctuation at its ends."""
    plain = word.decode("utf-8", "replace").lower().strip(EDGE)
    if len(plain) <= PIECE:
        return [plain]
    return [plain[at : at + PIECE] for at in range(0, len(plain) - PIECE // 2, PIECE // 2)]


_SPELLED = re.compile(rf"(?<![^{BLANKS}])(?:[^{BLANKS}][{BLANKS}]+){{{ORDER - 1},}}[^{BLANKS}](?![^{BLANKS}])")


def spelled(text: str) -> list[bytes]:
    """Runs of ORDER or more single characters, joined."""
    return ["".join(run.split()).encode() for run in _SPELLED.findall(text)]


#: Scores of words and strings by model, in a worker and across its tasks: a young and an old
#: half; when the young one is full it becomes the old one, so frequent words stay.
_MEMORY: dict[str, list[dict]] = memory()


@dataclass
class Model:
    """Landmarks, the machine's weights over them, and the logistic curve."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.spelling = Spelling(self.landmarks, self.weights[:, None])

    def string_scores(self, strings: list[str]) -> np.ndarray:
        return self.spelling.values(strings)[:, 0] + self.bias

    def worst(self, texts: list[str]) -> np.ndarray:
        """Score of each text's worst string; ``bias`` for a text without strings."""
        split = [text.encode().lower().split() + spelled(text.lower()) for text in texts]
        if self.name not in _MEMORY:
            forget()
            _MEMORY[self.name] = [{}, {}]
        if len(_MEMORY[self.name][0]) > REMEMBERED:
            _MEMORY[self.name] = [{}, _MEMORY[self.name][0]]
        memory, old = _MEMORY[self.name]  # words as bytes and the strings they are read as
        missing = list(filterfalse(memory.__contains__, set().union(*split)))
        memory.update([(word, old[word]) for word in filter(old.__contains__, missing)])
        cut = {word: pieces_of(word) for word in filterfalse(old.__contains__, missing)}
        fresh = list(filterfalse(memory.__contains__, {piece for pieces in cut.values() for piece in pieces}))
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            memory.update(zip(some, self.string_scores(some).tolist(), strict=True))
        for word, pieces in cut.items():
            memory[word] = memory[pieces[0]] if len(pieces) == 1 else max([memory[piece] for piece in pieces])
        return np.array([max(map(memory.__getitem__, words), default=self.bias) for words in split], dtype=np.float64)


def machine(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge, by Newton steps on the rows
    inside the margin. ``labels`` are 1 and -1."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = np.flatnonzero(labels * (x @ w) < 1)
        curve, pull = ridge.copy(), np.zeros(x.shape[1])
        for at in range(0, len(inside), 4096):
            rows = inside[at : at + 4096]
            some = x[rows]
            curve += (some * (c * weights[rows])[:, None]).T @ some
            pull += some.T @ (c * weights[rows] * labels[rows])
        step = np.linalg.solve(curve, pull)
        if np.allclose(step, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * step
    return w[:-1], float(w[-1])


def logistic(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps, halved until they help, with a weak
    prior on both."""
    x = np.stack([scores, np.ones_like(scores)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.005 * w @ w)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def gapped(word: str) -> list[str]:
    """The word and its forms with one character put in between."""
    return [word, *[word[:at] + sign + word[at:] for at in range(1, len(word)) for sign in "-*x"]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """At most TOXIC_ROWS and CLEAN_ROWS ids of each label outside the held-out fold, by digest."""
    known = labels.select(F.col(doc_id).alias("_llm_id"), F.col(label).cast("int").alias("_llm_toxic")).dropna()
    one = known.filter(~held_out(F.col("_llm_id"))).groupBy("_llm_id").agg(F.max("_llm_toxic").alias("_llm_toxic"))
    order = F.md5(F.col("_llm_id").cast("string"))
    toxic = one.filter("_llm_toxic = 1").orderBy(order, "_llm_id").limit(TOXIC_ROWS)
    return toxic.unionByName(one.filter("_llm_toxic = 0").orderBy(order, "_llm_id").limit(CLEAN_ROWS))


def sentence_words(sample: DataFrame) -> DataFrame:
    """``toxic, word, around``: the words of each sentence with a hash of both neighbours."""
    sentences = sample.select("toxic", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence"))
    words = sentences.select("toxic", F.regexp_extract_all("sentence", F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    each = words.select("toxic", "words", F.posexplode("words").alias("at", "word"))
    near = F.xxhash64(F.get("words", F.col("at") - 1), F.get("words", F.col("at") + 1))
    plain = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return each.select("toxic", plain.alias("word"), near.alias("around")).filter(F.length("word").between(ORDER, PIECE))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The fitted model, or None when no toxic training sentence stands out."""
    chosen = shared_table(labelled_sample(labels, doc_id, label).coalesce(1), "labelled")
    # TOXIC_ROWS + CLEAN_ROWS rows of two numbers, so broadcasting them is bounded.
    sample = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("_llm_id")
    )
    sample = shared_table(sample.select("id", "text", F.col("_llm_toxic").alias("toxic")), "sample")
    around = sentence_words(sample).groupBy("word", "around").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"))
    stats = around.groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(F.lit(1) - F.col("clean")).alias("b")
    )
    stats = shared_table(stats, "words")
    n_words, toxic, clean = stats.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    if not toxic:
        return None
    # Most of a word's surroundings are toxic, and the log-likelihood that they are more
    # toxic than all beats the number of words that were tried.
    share, n = toxic / (toxic + clean), F.col("a") + F.col("b")
    evidence = F.col("a") * F.log(F.greatest(F.col("a") / n, F.lit(1e-12)) / share)
    evidence += F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / max(1e-12, 1 - share))).otherwise(0.0)
    sure = stats.withColumn("evidence", evidence).filter((F.col("a") / n > 0.5) & (F.col("a") / n > share) & (F.col("evidence") > math.log(n_words / ACCIDENT)))
    best = sure.orderBy(F.desc("evidence"), "word").collect()  # all of them: bounded by the sample
    if not best:
        return None
    sure_words = [row["word"] for row in best]
    # A positive example that a few clean sentences have is not a negative one as well.
    found = F.broadcast(sure.select("word"))
    harmless = stats.filter("b > 0").select("word").join(found, "word", "left_anti")
    drawn = [row["word"] for row in harmless.orderBy(F.md5("word")).limit(NEGATIVES).collect()]

    @F.arrow_udf(T.DoubleType())
    def nearest(words: pa.Array) -> pa.Array:
        return pa.array(kernel_values(words.to_pylist(), sure_words).max(axis=1).astype(np.float64))

    close = [row["word"] for row in harmless.orderBy(F.desc(nearest("word")), "word").limit(CLOSE).collect()]
    negatives = sorted(set(drawn) | set(close))
    landmarks = sure_words + close[:CLEAN_LANDMARKS]
    positives = [(form, row["a"]) for row in best for form in gapped(row["word"])]
    own = kernel_values(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    features = kernel_values([p for p, _ in positives] + negatives, landmarks) @ whiten
    signs = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
    share = np.array([float(a) for _, a in positives])
    weight = np.concatenate([share / share.sum(), np.full(len(negatives), 1 / max(1, len(negatives)))]) * len(signs) / 2
    w, bias = machine(features, signs, weight)
    model = Model(landmarks, (whiten @ w).astype(np.float32), bias)
    fitted = sample.select("toxic", worst_score(model, F.col("text")).alias("worst")).collect()  # bounded by the sample
    model.slope, model.shift = logistic(
        np.array([row["worst"] for row in fitted]), np.array([float(row["toxic"]) for row in fitted])
    )
    return model


def worst_score(model: Model, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.worst(texts.slice(start, end - start).to_pylist()) for start, end in portions(texts, PORTION))]))

    return scored(text)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Score column for ``docs``; texts go to Python, only numbers come back."""
    if model is None:
        return F.lit(0.0)
    worst = worst_score(model, whole_text(text))
    return 1.0 / (1.0 + F.exp(-(worst * model.slope + model.shift)))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that score 0.5 or more, columns as they were."""
    return docs.filter(score(docs, train(docs, labels, doc_id, text), text) < 0.5)
