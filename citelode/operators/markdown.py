"""Paged Markdown to reading-order items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions import text as T

# Fixed values -------------------------------------------------------------------
PAGE_MARK = r"(?m)^\{(\d+)\}-{5,}\s*$"
IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
STRUCTURAL_TAGS = "div|b|i|u|em|strong|td|tr|th|table|li|ul|ol|p|span|sup|sub"
#: Applied in this order: captions, images, links, form boxes, breaks, tags, escapes.
CLEANING = (
    (r"(?is)<p>\s*Image:.*?</p>", " "),
    (r"(?i)<img\b[^>]*>", " "),
    (IMAGE, " "),
    (r"(?<!!)\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?i)<input\b[^>]*>", " "),
    (r"(?i)<br\s*/?>", " "),
    (rf"(?i)</?(?:{STRUCTURAL_TAGS})\b[^>]*>", " "),
    (r"\\([$*_#\[\]()~`>+=|{}.!-])", "$1"),
)
TABLE_ROW = r"^\s*\|"
TABLE_RULE = r"^\s*\|[\s|:-]+\|?\s*$"
# --------------------------------------------------------------------------------


def clean(text: Column) -> Column:
    """Markdown artefacts out, document text kept; a bare line that repeats an image's
    alternative text goes as well."""
    alts = T.non_blank(F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), T.strip))
    out = reduce(lambda t, rule: F.regexp_replace(t, *rule), CLEANING, text)
    kept = F.array_join(
        F.filter(F.split(out, "\r\n|[\n\r]"), lambda line: ~F.array_contains(alts, T.strip(line))), "\n"
    )
    out = F.when(F.size(alts) > 0, kept).otherwise(out)
    return T.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def split_pages(docs: DataFrame) -> DataFrame:
    """``text`` to one row per page: ``page`` (1-based) and ``body``. Text before the
    first mark belongs to no page; a repeated page number keeps its last body."""
    others = [c for c in docs.columns if c != "text"]
    numbers = F.regexp_extract_all("text", F.lit(PAGE_MARK), F.lit(1))
    bodies = F.split("text", PAGE_MARK)
    zipped = F.arrays_zip(
        numbers.alias("number"), F.slice(bodies, 2, F.size(numbers)).alias("body")
    )
    pages = T.each(docs, others, zipped, "pos", "p").select(
        *others, (F.col("p.number").cast("int") + 1).alias("page"), F.col("p.body").alias("body"), "pos"
    )
    return pages.groupBy(*others, "page").agg(F.max_by("body", "pos").alias("body"))


def _cells(line: Column) -> Column:
    """Cells between the pipes of one row, the outer pipes aside."""
    inner = F.regexp_replace(F.regexp_replace(T.strip(line), r"^\|", ""), r"\|$", "")
    needs_cleaning = lambda c: c.rlike(r"[<\[\\]|[ \t]{2}|\t")
    return F.transform(
        F.split(inner, r"\|"),
        lambda c: F.when(needs_cleaning(c), clean(c)).otherwise(T.strip(c)),
    )


def table_grids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pipe-table lines (``keys``, ``pos``, ``line``) to one ``grid`` per table: rule
    lines, empty rows and empty columns dropped, ragged rows padded. Tables with no
    content give no row."""
    cells = T.each(
        rows.filter(~F.col("line").rlike(TABLE_RULE)), [*keys, "pos"], _cells(F.col("line")), "col", "cell"
    )
    filled = cells.filter(F.col("cell") != "")
    by_row = filled.groupBy(*keys, "pos").agg(
        F.collect_list(F.struct("col", "cell")).alias("row")
    )
    live = (
        by_row.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("rows"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.col("row.col"))))).alias("cols"),
        )
    )
    return live.select(
        *keys,
        F.transform(
            "rows",
            lambda r: F.transform(
                F.col("cols"),
                lambda c: F.coalesce(
                    F.get(F.filter(r["row"], lambda e: e["col"] == c), F.lit(0))["cell"], F.lit("")
                ),
            ),
        ).alias("grid"),
    )


def grid_markdown(grid: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(grid, F.lit(0)))))
    lines = F.transform(grid, line)
    return F.array_join(
        F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n"
    )


def page_items(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (``keys``, ``page``, ``body``) to reading-order items: ``seq, kind, text``
    and, for tables, ``grid``. Runs of pipe lines are tables, runs of other lines are
    cleaned and split into paragraphs. Lines of one page share a task; pages are small."""
    lines = T.each(
        pages, [*keys, "page"], F.split("body", "\r\n|[\n\r]"), "pos", "line"
    ).withColumn("is_row", F.col("line").rlike(TABLE_ROW))
    in_page = Window.partitionBy(*keys, "page").orderBy("pos")
    turned = F.col("is_row") != F.lag("is_row", 1).over(in_page)
    lines = lines.withColumn(
        "run", F.sum(F.coalesce(turned, F.lit(True)).cast("int")).over(in_page)
    )
    tables = table_grids(lines.filter("is_row"), [*keys, "page", "run"]).select(
        *keys, "page", "run", F.lit(0).alias("part"), F.lit("table").alias("kind"),
        grid_markdown(F.col("grid")).alias("text"), "grid",
    )
    runs = lines.filter(~F.col("is_row")).groupBy(*keys, "page", "run").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n"
        ).alias("body")
    )
    prose = T.each(
        runs, [*keys, "page", "run"], T.paragraphs(clean(F.col("body"))), "part", "text"
    ).select(*keys, "page", "run", "part", F.lit("text").alias("kind"), "text",
             F.lit(None).cast("array<array<string>>").alias("grid"))
    reading = Window.partitionBy(*keys).orderBy("page", "run", "part")
    return tables.unionByName(prose).withColumn(
        "seq", F.row_number().over(reading).cast("long") - 1
    ).drop("run", "part")
