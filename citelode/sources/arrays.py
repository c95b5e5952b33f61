"""Records of JSON arrays larger than a task may hold.

A file is read in pieces that end with a closing brace, so that its splits go to different tasks. A piece does not know
whether it starts inside a string or how deep, so each is summed up first: how its quotes and its brackets change the
state, under both assumptions. Running sums over the pieces of a file give every piece its state, the places
where an element of the wanted array ends are the borders of the records, and the pieces between two
borders are put together, wherever the splits cut them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators.scan import blocked_last_value, blocked_running_sum, integer_block

#: Every piece ends with this character; the reader takes it away.
END = "}"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep=END).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"),
    )


def _outside(piece: Column, inside: bool) -> Column:
    """The piece without its strings, if it starts outside (or inside) of one; escapes are gone already."""
    text = F.regexp_replace(piece, r'^[^"]*("|$)', "") if inside else piece
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _depth(outside: Column, ends_outside: Column) -> Column:
    """Change of depth, the closing brace at the end of the piece included if it is no part of a string."""
    return _count(outside, "{[") - _count(outside, "}]") - F.when(ends_outside, 1).otherwise(0)


def array_elements(spark: SparkSession, path: str | list[str], key: str = "questions") -> DataFrame:
    """``file, element, json``: the objects of a bare array, or of the array under ``key`` in an object, in file order
    (``element`` rises, with gaps). Other files and other values give nothing."""
    pieces = _pieces(spark, path).withColumn("plain", F.regexp_replace("piece", r"\\.", ""))
    odd = (_count(F.col("plain"), '"') % 2).alias("odd")
    order, group = [F.col("id")], ["file"]
    summed = pieces.select("file", "start", "id", "piece", "plain", odd)
    quotes = blocked_running_sum(summed, group, "start", order, "odd", "quotes")
    inside = (F.col("quotes") - F.col("odd")) % 2 == 1
    outside = F.when(inside, _outside(F.col("plain"), True)).otherwise(_outside(F.col("plain"), False))
    known = quotes.select("file", "start", "id", "piece", (F.col("quotes") % 2 == 0).alias("ends_outside"), outside.alias("outside"))
    known = known.withColumn("change", _depth(F.col("outside"), F.col("ends_outside")))
    deep = blocked_running_sum(known, group, "start", order, "change", "depth")
    # A file is a bare array if its first sign is a bracket; then its elements end at depth 1, else at 2.
    heads = deep.groupBy("file").agg(F.min_by(F.ltrim("piece"), "id").startswith("[").alias("bare"))
    base = F.when(F.col("bare"), 1).otherwise(2)
    marked = deep.join(F.broadcast(heads), "file")  # one row per file
    ends = (F.col("ends_outside") & (F.col("depth") == base)).cast("int")
    bordered = blocked_running_sum(marked.withColumn("ends", ends), group, "start", order, "ends", "passed")
    whole = bordered.groupBy("file", "bare", (F.col("passed") - F.col("ends")).alias("element")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda x: F.concat(x["piece"], F.lit(END))), "").alias("text"),
        F.max("ends").alias("closed"),
    ).filter("closed = 1")
    # In an object, an element follows a comma or starts an array, whose name holds until something else starts.
    follows = F.col("text").rlike(r"^\s*,[^{:]*\{")
    name = F.when(~follows, F.regexp_extract("text", r'(?s)^\s*[{}\],].*?"([^"]*)"\s*:\s*\[\s*\{', 1))
    blocks = whole.withColumn("own", name).withColumn("block", integer_block(F.col("element")))
    named = blocked_last_value(blocks, group, "block", [F.col("element")], F.col("own"), "last")
    wanted = named.filter(F.col("bare") | (F.coalesce("own", "last") == F.lit(key)))
    opening = rf'(?s)^.*?"\Q{key}\E"\s*:\s*\[\s*(?=\{{)'
    cut = F.when(F.col("bare") | F.col("own").isNull(), F.regexp_replace("text", r"^[^{]*", "")).otherwise(F.regexp_replace("text", opening, ""))
    return wanted.select("file", "element", cut.alias("json"))
