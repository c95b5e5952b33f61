"""Tokenizing for models that fail, take only short texts, or analyse words.

A long text is cut into segments before a model sees it, segments are handed over in batches of
bounded length, and a batch that fails is halved until the segment at fault is alone; only that one falls back
to plain tokens. Analyses of a token (its words with their lemmas) are united into search tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import text as T

# Characters of a segment, and of all segments of one model call.
SEGMENT_CHARS = 4_000
CALL_CHARS = 16_000

SEGMENTS = "array<struct<start:int,length:int>>"
#: What an analyser returns for a text: its tokens, each with the words it consists of.
ANALYSES = "array<struct<surface:string,words:array<struct<text:string,lemma:string>>>>"


def segment_spans(text: str, most: int = SEGMENT_CHARS) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive segments of at most ``most`` characters that cover the text:
    as many whole lines as fit; of a longer line as much as fits up to a space; else the characters that fit."""
    start, size = 0, len(text)
    while size - start > most:
        end = start + most
        line = text.rfind("\n", start, end) + 1
        space = 0 if line else text.rfind(" ", start + 1, end)
        cut = line or (space if space > 0 else end)
        yield start, cut - start
        start = cut
    yield start, size - start


def segments(text: Column, most: int = SEGMENT_CHARS) -> Column:
    """Array of ``start, length`` of a text's segments; nothing for null. Only texts longer than a
    segment reach Python."""

    @F.pandas_udf(SEGMENTS)
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"start": a, "length": n} for a, n in segment_spans(v, most)], na_action="ignore")

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("length")))
    return F.when(F.length(text) <= most, whole).otherwise(cut(F.when(F.length(text) > most, text)))


def segment_rows(texts: DataFrame, keep: list[str], text: str = "text", most: int = SEGMENT_CHARS) -> DataFrame:
    """One row per segment: ``keep``, ``segment`` (from 0), ``start``, and its characters as ``piece``. Joined in
    order the pieces give the text."""

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [v[a:a + n] for a, n in segment_spans(v, most)], na_action="ignore")

    long = F.length(text) > most
    pieces = F.when(long, cut(F.when(long, F.col(text)))).otherwise(F.array(text))
    spans = texts.filter(F.col(text).isNotNull()).select(*keep, pieces.alias("pieces"))
    rows = T.each(spans, keep, F.col("pieces"), "segment", "piece")
    return rows


def calls(sizes: list[int], most: int = CALL_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive segments for one model call each: as many as stay within ``most`` characters, one
    at least."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def tokenized(model: Callable[[list[str]], list[list[str]]], plain: Callable[[str], list[str]], pieces: list[str]) -> list[tuple[list[str], bool]]:
    """Tokens of each piece and whether it fell back to ``plain``. A failing call is halved, so
    that one bad piece costs two calls for each doubling of the batch."""
    try:
        found = model(pieces)
        if len(found) != len(pieces):
            raise ValueError(f"{len(found)} results for {len(pieces)} texts")
        return [(list(tokens), False) for tokens in found]
    except Exception:
        if len(pieces) == 1:
            return [(plain(pieces[0]), True)]
        middle = len(pieces) // 2
        return tokenized(model, plain, pieces[:middle]) + tokenized(model, plain, pieces[middle:])


def tokenize(
    texts: DataFrame, keep: list[str], model: Callable[[list[str]], list[list[str]]], plain: Callable[[str], list[str]],
    text: str = "text", most: int = SEGMENT_CHARS, budget: int = CALL_CHARS,
) -> DataFrame:
    """``keep``, ``tokens`` of each text, ``segments`` and ``fallbacks`` (segments that the model refused).
    Texts with a fallback should not enter a cache. Null texts have null tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch[text].to_pylist()
            pieces = [[v[a:a + n] for a, n in segment_spans(v, most)] if v is not None else [] for v in values]
            flat = [piece for of in pieces for piece in of]
            found: list[tuple[list[str], bool]] = []
            for start, end in calls([len(piece) for piece in flat], budget):
                found += tokenized(model, plain, flat[start:end])
            at, tokens, fallbacks = iter(found), [], []
            for value, of in zip(values, pieces):
                own = [next(at) for _ in of]
                tokens.append(None if value is None else [token for some, _ in own for token in some])
                fallbacks.append(sum(failed for _, failed in own))
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in keep], pa.array(tokens, pa.list_(pa.string())),
                 pa.array([len(of) for of in pieces], pa.int32()), pa.array(fallbacks, pa.int32())],
                names=[*keep, "tokens", "segments", "fallbacks"],
            )

    kinds = dict(texts.dtypes)
    shape = "".join(f"`{name}` {kinds[name]}, " for name in keep)
    return texts.select(*keep, text).mapInArrow(run, shape + "tokens array<string>, segments int, fallbacks int")


#: Stands between forms while they are composed together; tokens treat it as white space anyway.
_BETWEEN = "\x1e"


def with_united_tokens(frame: DataFrame, analyses: str, name: str = "tokens", surfaces: bool = True) -> DataFrame:
    """``frame`` with search tokens of the analysed tokens in column ``analyses`` (as ``ANALYSES``): of every
    token the lemma of each word (or its text), the word's text, and the token as it stands, in this order and
    without repeats inside the token. Without ``surfaces`` the lemmas alone; null gives null."""

    def word(w: Column) -> Column:
        lemma = F.coalesce(F.when(w["lemma"] != "", w["lemma"]), w["text"])
        return F.array(lemma, w["text"]) if surfaces else F.array(lemma)

    def token(t: Column) -> Column:
        forms = F.flatten(F.transform(t["words"], word))
        return F.filter(F.concat(forms, F.array(t["surface"])) if surfaces else forms, lambda f: f.isNotNull())

    placed = F.flatten(F.transform(F.col(analyses), lambda t, i: F.transform(
        token(t), lambda f: F.struct(i.alias("i"), F.translate(f, _BETWEEN, " ").alias("f"))
    )))
    # All forms of a text are composed as one string: a Python helper cannot stand inside a lambda.
    joined = frame.withColumn("__placed", placed).withColumn("__joined", F.array_join("__placed.f", _BETWEEN))
    composed = joined.withColumn("__forms", F.split(T.nfc(F.col("__joined")), _BETWEEN))
    found = F.zip_with("__placed", "__forms", lambda x, f: F.transform(T.composed_tokens(f), lambda n: F.struct(x["i"].alias("i"), n.alias("n"))))
    return composed.withColumn(name, F.transform(F.array_distinct(F.flatten(found)), lambda x: x["n"])).drop("__placed", "__joined", "__forms")


def suffix_analyses(text: Column) -> Column:
    """Stand-in for a morphological model: a token is cut at apostrophes into words, and a word
    longer than four characters loses a final ``s`` in its lemma."""
    surface = F.filter(F.split(T.strip(text), T.SPACES), lambda t: t != "")

    def word(w: Column) -> Column:
        lemma = F.when((F.length(w) > 4) & (F.right(w, F.lit(1)) == "s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        return F.struct(w.alias("text"), lemma.alias("lemma"))

    return F.transform(surface, lambda t: F.struct(t.alias("surface"), F.transform(F.split(t, "'"), word).alias("words")))
