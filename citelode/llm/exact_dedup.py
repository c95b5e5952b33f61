"""Exact duplicates by composable polynomial fingerprints.

A text is hashed in pieces. The piece hash is an affine map (value, shift) modulo a prime,
and two neighbouring pieces compose to the map of their concatenation, so pieces of one
huge document can be hashed anywhere and combined afterwards. Documents with equal
fingerprints are then compared piece by piece, and only if every piece agrees are they
one group.

Defined cases: a null text is an empty text, and empty texts are equal to each other. Of
equal texts the one with the most code points in the original stays, then the smallest
id; a null id is larger than any other. Rows that repeat an id with a text of the same
length are one document: each is marked as kept by ``duplicate_groups``, and one of them
survives ``drop_duplicates``. Columns besides id and text are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import BLANKS, BlockedBloom, forget, one_of_each, row_key, same, tidy, whole_text
from citelode.session import shared_table

#: Two primes under 2^31, so that products stay inside a long, and their bases.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes in a hashed piece and code points in a compared piece.
HASHED = 1 << 16
COMPARED = 1 << 16

_FIELDS = ("h1", "s1", "h2", "s2", "n")
_PIECES = T.ArrayType(T.StructType([T.StructField(field, T.LongType()) for field in _FIELDS]))


def _powers(base: int, prime: int) -> np.ndarray:
    """base^0 .. base^HASHED modulo prime, by doubling."""
    out = np.ones(HASHED + 1, dtype=np.uint64)
    done = 1
    while done <= HASHED:
        more = min(done, HASHED + 1 - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


_TABLES: list[np.ndarray] = []


def piece_maps(data: bytes, size: int = HASHED) -> list[tuple[int, int, int, int, int]]:
    """(value, shift) for each prime and the length, for each piece of ``data``."""
    if not _TABLES:
        _TABLES.extend(_powers(base, prime) for base, prime in zip(BASES, PRIMES, strict=True))
    out = []
    for at in range(0, len(data), size):
        piece = np.frombuffer(data[at : at + size], dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        n, row = len(piece), []
        for powers, prime in zip(_TABLES, PRIMES, strict=True):
            row += [int(np.dot(piece, powers[n - 1 :: -1]) % np.uint64(prime)), int(powers[n])]
        out.append((*row, n))
    return out


@F.arrow_udf(_PIECES)
@tidy
def hash_pieces(texts: pa.Array) -> pa.Array:
    forget()
    rows = [[dict(zip(_FIELDS, piece, strict=True)) for piece in piece_maps(text.as_py().encode())] for text in texts]
    return pa.array(rows, type=pa.list_(pa.struct([(field, pa.int64()) for field in _FIELDS])))


def compose(pieces: Column) -> Column:
    """Fingerprint of pieces in order: shift what is there past the next piece, add it."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            ((acc["h1"] * x["s1"] + x["h1"]) % PRIMES[0]).alias("h1"),
            ((acc["h2"] * x["s2"] + x["h2"]) % PRIMES[1]).alias("h2"),
            (acc["n"] + x["n"]).alias("n"),
        )

    zero = F.lit(0).cast("long")
    return F.aggregate(pieces, F.struct(zero.alias("h1"), zero.alias("h2"), zero.alias("n")), step)


def fingerprint_parts(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Fingerprints of documents stored as ordered part rows, each part hashed where it lies."""
    hashed = parts.select(key, F.struct(F.col(order).alias("at"), hash_pieces(whole_text(text)).alias("pieces")).alias("part"))
    inner = F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda part: part["pieces"]))
    return hashed.groupBy(key).agg(compose(inner).alias("fingerprint"))


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _probe(text: Column) -> Column:
    return F.xxhash64(normalised(text))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: id, row key, length, fingerprint, digest."""
    raw = whole_text(text)
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(doc_id, raw).alias("row"), F.length(raw).cast("long").alias("chars"),
        normalised(raw).alias("plain"),
    )
    return plain.select(
        "doc_id", "row", "chars", compose(hash_pieces("plain")).alias("print"), F.xxhash64("plain").alias("probe"),
        F.sha2("plain", 256).alias("text_sha256"),
    ).select("doc_id", "row", "chars", "print.h1", "print.h2", "print.n", "probe", "text_sha256")


PRINT = ["h1", "h2", "n"]


@F.arrow_udf(T.ArrayType(T.StringType()))
@tidy
def compared_pieces(texts: pa.Array) -> pa.Array:
    """A text in pieces of ``COMPARED`` characters, cut in one pass; an empty text is one empty piece."""
    rows = ([text[at : at + COMPARED] for at in range(0, max(1, len(text)), COMPARED)] for text in texts.to_pylist())
    return pa.array(rows, type=pa.list_(pa.string()))


def false_matches(docs: DataFrame, text: str, suspects: DataFrame) -> DataFrame:
    """Fingerprints shared by texts that differ. ``suspects`` has the probes of documents
    that share a fingerprint; only these are read again. Equal pieces collapse in the map
    stage, so a group of any size sends one row per task and piece."""
    bloom = BlockedBloom.build(suspects, "probe")
    raw = whole_text(text)
    again, _ = bloom.split(docs.select(raw.alias("raw")), _probe(F.col("raw")))
    prints = again.select(normalised(F.col("raw")).alias("plain")).withColumn("print", compose(hash_pieces("plain")))
    cut = prints.select("print.*", F.posexplode(compared_pieces("plain")).alias("at", "piece"))
    variants = cut.groupBy(*PRINT, "at", "piece").agg(F.lit(1).alias("one")).groupBy(*PRINT, "at").agg(F.count("*").alias("variants"))
    return variants.filter("variants > 1").select(*PRINT).distinct()


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and the digest of its text."""
    rows = shared_table(identify(docs, doc_id, text), "prints")
    shared = shared_table(rows.groupBy(*PRINT).agg(F.count("*").alias("size")).filter("size > 1").select(*PRINT), "shared")
    suspects = shared_table(rows.join(shared, PRINT, "left_semi").select("probe").distinct(), "suspects")
    broken = shared_table(false_matches(docs, text, suspects), "broken")
    key = [*PRINT, "variant"]
    if broken.isEmpty():
        rows = rows.withColumn("variant", F.lit(""))
    else:  # different texts behind one fingerprint: their digests part them
        marked = rows.join(broken.withColumn("split", F.lit(True)), PRINT, "left")
        rows = marked.withColumn("variant", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    best = F.min(F.struct((-F.col("chars")).alias("longest"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id")))
    groups = rows.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = shared_table(groups, "groups")
    judged = rows.join(groups, key, "left")
    alone = F.col("group_size").isNull()
    stays = same(F.col("doc_id"), F.col("best.id")) & (F.col("chars") == -F.col("best.longest"))
    return judged.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | stays).alias("kept"), "text_sha256",
        "row",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were.

    Only rows that share a fingerprint with another are shuffled."""
    judged = duplicate_groups(docs, doc_id, text).filter("group_size > 1").select(F.col("row").alias("key"), "kept")
    return one_of_each(docs, row_key(doc_id, whole_text(text)), shared_table(judged, "judged"))
