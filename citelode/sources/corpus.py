"""Document collections on a file system: discovery, hashing, text and page readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import markdown
from citelode.operators.sizing import small_side

# Fixed values -------------------------------------------------------------------
CATEGORIES = (
    "apartment", "business", "car", "dental", "diseases-disabilities", "health", "life",
    "long-term-care", "loss-of-working-ability", "mortgage", "personal-accident", "travel",
)
# --------------------------------------------------------------------------------


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel, modified, size`` of every file below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "^.*" + "\\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + "\\E/"
    rel = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), prefix, "")
    return found.select(
        "path", T.nfc(rel).alias("rel"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    )


def discover(
    spark: SparkSession, root: str, prefer: str = "pdf", categories: tuple[str, ...] = CATEGORIES
) -> DataFrame:
    """Documents of a corpus: ``path, file, category, kind``.

    Layout: ``<category>/files/*.pdf``, ``<category>/markdown-files/*.md`` and
    ``<category>/pages/*.txt``. With ``prefer="markdown"`` a Markdown file stands for the
    PDF of the same name, takes its path and needs it to exist.
    """
    parts = r"^([^/]+)/(files|markdown-files|pages)/([^/]+)\.(pdf|md|txt)$"
    group = lambda i: F.regexp_extract("rel", parts, i)
    listed = list_files(spark, root).select(
        "path", "rel", group(1).alias("category"), group(2).alias("folder"), group(3).alias("stem"), group(4).alias("kind")
    ).filter(F.col("category").isin(*categories))
    texts = listed.filter((F.col("folder") == "pages") & (F.col("kind") == "txt"))
    pdfs = listed.filter((F.col("folder") == "files") & (F.col("kind") == "pdf"))
    if prefer == "markdown":
        md = listed.filter((F.col("folder") == "markdown-files") & (F.col("kind") == "md"))
        pdf_path = F.concat("category", F.lit("/files/"), "stem", F.lit(".pdf"))
        pdfs = md.join(pdfs.select("category", "stem"), ["category", "stem"], "left_semi").withColumn("rel", pdf_path)
    columns = ["path", F.col("rel").alias("file"), "category", "kind"]
    return texts.select(columns).unionByName(pdfs.select(columns))


def subset(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted categories; one that holds no file is an error."""
    present = {r[0] for r in files.filter(F.col("category").isin(*wanted)).select("category").distinct().collect()}
    unknown = sorted(set(wanted) - present)
    if unknown:
        raise ValueError(f"no files in categories: {', '.join(unknown)}")
    return files.filter(F.col("category").isin(*wanted))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256`` of every file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def with_urls(files: DataFrame, manifest_path: str) -> DataFrame:
    """Attach ``source_url`` from a JSON map of path to URL."""
    spark = files.sparkSession
    raw = spark.read.text(manifest_path, wholetext=True)
    urls = T.each(
        raw, [], F.map_entries(F.from_json("value", "map<string,string>")), "e"
    ).select(T.nfc(F.col("e.key")).alias("file"), F.col("e.value").alias("source_url"))
    return files.join(small_side(urls), "file", "left")


def read_corpus_texts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Whole text of each listed file as ``text``. The tree is read once and joined to
    the list, so that no paths pass through the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.join(raw.select("path", F.decode("content", "UTF-8").alias("text")), "path")


def markdown_items(texts: DataFrame) -> DataFrame:
    """Markdown files to reading-order items; files without a page mark are returned by
    :func:`unpaged` and give no items."""
    pages = markdown.split_pages(texts.filter(F.col("kind") == "md").select("file", "category", "text"))
    return markdown.page_items(pages, ["file", "category"])


def unpaged(texts: DataFrame) -> DataFrame:
    return texts.filter((F.col("kind") == "md") & ~F.col("text").rlike(markdown.PAGE_MARK)).select("file")
