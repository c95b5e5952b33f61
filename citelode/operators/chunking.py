"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import text as T


def chunk_id(file: Column, page: Column, n: Column) -> Column:
    return F.concat(
        file, F.lit("#p"), F.coalesce(page.cast("string"), F.lit("null")), F.lit("#c"), n.cast("string")
    )


def _fits(counts: Column, start: Column, width: int, max_tokens: int) -> Column:
    """Longest window of at most ``width`` sentences from ``start`` within the token
    cap; a single sentence always stands."""
    left = F.least(F.lit(width), F.size(counts) - start)
    lengths = F.filter(
        F.sequence(F.lit(1), left),
        lambda n: T.tokens_for_words(
            F.aggregate(F.slice(counts, start + 1, n), F.lit(0), lambda a, w: a + w)
        )
        <= max_tokens,
    )
    return F.greatest(F.lit(1), F.coalesce(F.array_max(lengths), F.lit(1)))


def sentence_windows(
    df: DataFrame, text: str, width: int = 7, overlap: int = 2, max_tokens: int = 512
) -> DataFrame:
    """One row per window: ``n`` (0-based), ``start``, ``length`` in sentences, and
    ``text``, replaced by the window's text.

    Windows repeat ``overlap`` sentences. While no window hits the token cap the starts
    are an arithmetic sequence. When one does, the next start depends on how far the
    shortened window reached, so the starts are folded along the sentence array.
    """
    if width <= overlap:
        raise ValueError("width must exceed overlap")
    stride = width - overlap
    split = (
        df.filter(T.strip(F.col(text)) != "")
        .withColumn("__sents", T.sentences(F.col(text)))
        .withColumn("__counts", F.transform("__sents", lambda s: F.size(F.split(s, T.SPACES))))
    )
    n = F.size("__sents")
    counts = F.col("__counts")
    # No run of ``width`` sentences can exceed the cap if none exceeds it on its own.
    even = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - width) / F.lit(stride)).cast("int"))),
        lambda k: (k * stride).cast("int"),
    )
    even_fits = F.forall(
        even,
        lambda s: T.tokens_for_words(
            F.aggregate(F.slice(counts, s + 1, width), F.lit(0), lambda a, w: a + w)
        )
        <= max_tokens,
    )
    state = F.struct(
        F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts")
    )

    def step(acc: Column, i: Column) -> Column:
        length = _fits(counts, i, width, max_tokens)
        following = F.when(i + length >= n, n).otherwise(
            i + F.greatest(F.lit(1), length - overlap)
        )
        return F.when(i != acc["next"], acc).otherwise(
            F.struct(
                following.cast("int").alias("next"),
                F.array_append(acc["starts"], i).alias("starts"),
            )
        )

    folded = F.aggregate(F.sequence(F.lit(0), n - 1), state, step, lambda acc: acc["starts"])
    starts = F.when(even_fits, even).otherwise(folded)
    windows = (
        split.withColumn("__starts", starts)
        .select(
            *[c for c in df.columns if c != text],
            "__sents",
            "__counts",
            F.posexplode_outer("__starts").alias("n", "start"),
        )
        .withColumn("length", _fits(F.col("__counts"), F.col("start"), width, max_tokens))
    )
    body = F.array_join(F.slice("__sents", F.col("start") + 1, F.col("length")), " ")
    return windows.withColumn(text, body).drop("__sents", "__counts")


def paragraph_packs(parts: Column, max_tokens: int) -> Column:
    """Greedy packs of consecutive paragraphs as ``array<struct<text,tokens,oversized>>``.

    A pack closes before the paragraph that would overflow it; a paragraph that is too
    long by itself is kept whole.
    """
    pack = "struct<text:string,tokens:int,oversized:boolean>"
    start = F.struct(
        F.array().cast(f"array<{pack}>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("tokens"),
    )

    def make(body: Column, tokens: Column, oversized: bool) -> Column:
        return F.struct(
            body.alias("text"), tokens.alias("tokens"), F.lit(oversized).alias("oversized")
        )

    def step(acc: Column, part: Column) -> Column:
        size = T.token_estimate(part)
        overflow = acc["open"].isNotNull() & (acc["tokens"] + size > max_tokens)
        done = F.when(
            overflow, F.array_append(acc["done"], make(acc["open"], acc["tokens"], False))
        ).otherwise(acc["done"])
        open_ = F.when(~overflow, acc["open"])
        alone = (size > max_tokens) & open_.isNull()
        return F.struct(
            F.when(alone, F.array_append(done, make(part, size, True))).otherwise(done).alias("done"),
            F.when(alone, F.lit(None).cast("string"))
            .otherwise(F.concat_ws("\n\n", open_, part))
            .alias("open"),
            F.when(alone, F.lit(0))
            .when(overflow, size)
            .otherwise(acc["tokens"] + size)
            .alias("tokens"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc["open"].isNotNull(),
            F.array_append(acc["done"], make(acc["open"], acc["tokens"], False)),
        ).otherwise(acc["done"])

    return F.aggregate(parts, start, step, finish)


def text_chunks(
    files: DataFrame, width: int = 7, overlap: int = 2, max_tokens: int = 512,
    chunker: str = "per_table", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Plain-text files (``file, category, text``) to chunks; pages are null. Columns of the
    files named in ``keep`` are carried along."""
    windows = sentence_windows(files, "text", width, overlap, max_tokens)
    page = F.lit(None).cast("int")
    return windows.select(
        chunk_id(F.col("file"), page, F.col("n")).alias("chunk_id"),
        "file",
        page.alias("page"),
        "category",
        "text",
        F.lit(chunker).alias("chunker"),
        *keep,
    )


def number_chunks(pieces: DataFrame, chunker: str) -> DataFrame:
    """Ordered pieces (``file, category, page, seq, text``) to numbered chunks: blank
    pieces go, the rest are counted per file. Files are documents, so a file's pieces
    fit one task."""
    from pyspark.sql import Window

    kept = pieces.filter(T.strip(F.col("text")) != "")
    n = F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1
    return kept.withColumn("__n", n).select(
        chunk_id(F.col("file"), F.col("page"), F.col("__n")).alias("chunk_id"),
        "file",
        "page",
        "category",
        "text",
        F.lit(chunker).alias("chunker"),
    )


def page_chunks(items: DataFrame, max_tokens: int = 1800) -> DataFrame:
    """One chunk per page from reading-order items (``file, category, page, seq,
    text``); a page over the cap is split at paragraph bounds and keeps its page."""
    usable = items.filter(F.col("page").isNotNull() & (T.strip(F.col("text")) != ""))
    pages = usable.groupBy("file", "category", "page").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]
        ).alias("parts")
    )
    whole = F.array_join("parts", "\n\n")
    fits = T.token_estimate(whole) <= max_tokens
    texts = F.when(fits, F.array(whole)).otherwise(
        F.transform(paragraph_packs(F.col("parts"), max_tokens), lambda p: p["text"])
    )
    pieces = T.each(pages, ["file", "category", "page"], texts, "part", "text").withColumn("seq", F.struct("page", "part"))
    return number_chunks(pieces, "per_page")


def table_chunks(items: DataFrame, prose_max_tokens: int = 512) -> DataFrame:
    """Tables as atomic chunks under their last heading, after the prose.

    ``items`` carries ``kind`` in (heading, text, table). Prose is packed per page,
    tables never enter it, so no table text is indexed twice.
    """
    from citelode.operators.scan import blocked_last_value, integer_block

    heading = F.when(
        (F.col("kind") == "heading") & (T.strip(F.col("text")) != ""), T.strip(F.col("text"))
    )
    carried = blocked_last_value(
        items.withColumn("__block", integer_block(F.col("seq"))),
        ["file"], "__block", [F.col("seq")], heading, "heading",
    ).drop("__block")
    tables = carried.filter((F.col("kind") == "table") & (T.strip(F.col("text")) != "")).select(
        "file", "category", "page",
        F.struct(F.lit(1).alias("after"), F.lit(0).alias("page"), F.col("seq").alias("n")).alias("seq"),
        F.concat_ws("\n\n", "heading", "text").alias("text"),
    )
    prose = items.filter(
        (F.col("kind") != "table") & F.col("page").isNotNull() & (T.strip(F.col("text")) != "")
    ).groupBy("file", "category", "page").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]
        ).alias("parts")
    )
    packs = paragraph_packs(F.col("parts"), prose_max_tokens)
    prose = T.each(prose, ["file", "category", "page"], packs, "part", "pack").select(
        "file", "category", "page",
        F.struct(F.lit(0).alias("after"), F.col("page").alias("page"), F.col("part").cast("long").alias("n")).alias("seq"),
        F.col("pack.text").alias("text"),
    )
    return number_chunks(prose.unionByName(tables), "per_table")
