"""Web archives: records written and read by Spark, and their index merged in order.

Records are built as strings and written by the text writer with the archive's record
separator, so executors need no shared local folder. Payloads that repeat are written
once; later captures are revisit records that name the first.

Reading back parses whole archive files. The index entries of one archive, sorted by URL
key and capture time, are a run. Ranges of the key space are then merged independently:
each task holds the slices of all runs that fall into its range and merges them with a
loser tree, so the entries come out in one global order, the history of each URL in time.

Defined cases: a null html is an empty payload. Of equal payloads of at least ``LEAST`` bytes the one
with the smallest page id is the response, the others revisit it; a null id is larger than any. Rows that
repeat an id and a payload are all responses. Smaller payloads are responses. A null url gives a record without
target and an empty URL key; blanks and control characters in a url are escaped. Without rows there is an empty
index. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citelode.llm.common import BlockedBloom, same, whole_text
from citelode.session import application_folder, shared_table

#: Bytes from which equal payloads are stored once.
LEAST = 100
#: Records and bytes of payload in an archive file (a single record may be larger), and index entries a merge task holds.
RECORDS, FILE_BYTES, ENTRIES = 4_000, 128_000_000, 50_000
END = "\r\n\r\n"
#: Pages carry no capture time; it is derived from the id, one second apart.
FIRST_CAPTURE, SECONDS = 1_704_067_200, 630_720_000


def record_id(page_id: Column, digest: Column) -> Column:
    hex_ = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    parts = [F.substring(hex_, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def capture_time(page_id: Column) -> Column:
    at = F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(page_id, F.lit(SECONDS)), F.lit(0))
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_captures(rows: DataFrame) -> DataFrame:
    """``digest, first`` of payloads that several rows share."""
    large = rows.filter(F.col("bytes") >= LEAST).select("page_id", "digest")
    return large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", largest: Observation | None = None) -> DataFrame:
    """``record, bytes``: each row as a WARC record, without the closing separator, and the size of its payload. ``largest``
    is told the size of the largest payload by the job that runs here."""
    payload = whole_text(html)
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"),
    )
    seen = rows if largest is None else rows.observe(largest, F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    shared = shared_table(first_captures(seen), "first-captures")
    bloom = BlockedBloom.build(shared.select(F.xxhash64("digest").alias("key")), "key")
    possible, alone = bloom.split(rows, F.xxhash64(F.sha2("payload", 256)))
    joined = possible.join(shared, "digest", "left")
    repeats = (F.col("bytes") >= LEAST) & F.col("first").isNotNull() & ~same(F.col("page_id"), F.col("first"))
    again = joined.withColumn("refers", F.when(repeats, F.col("first"))).drop("first")
    alone = alone.withColumn("refers", F.lit(None).cast(rows.schema["page_id"].dataType))
    every = alone.unionByName(again)
    revisit = F.col("refers").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))), line("WARC-Date", capture_time(F.col("page_id"))),
        line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("refers"), F.col("digest")))),
        line("WARC-Refers-To-Page-Id", F.col("refers").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"),
    )
    return every.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"), "bytes")


def write_archives(pages: DataFrame, folder: str | None = None, **columns: str) -> str:
    """Write archive files and return their folder, by default a new one in the application's. Files are bounded by
    records and bytes: payloads above the bytes that a file has for each record are written apart, so few to a file
    that the largest of them fit."""
    folder = folder or f"{application_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    largest = Observation()
    every = records(pages, largest=largest, **columns)
    try:
        most = largest.get["bytes"] or 0
    except Py4JJavaError:  # no rows
        most = 0
    share = FILE_BYTES // RECORDS

    def write(some: DataFrame, number: int) -> None:
        some.select("record").write.mode("append").option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", number).text(folder)

    if most <= share:
        write(every, RECORDS)
    else:
        write(every.filter(F.col("bytes") <= share), RECORDS)
        write(every.filter(F.col("bytes") > share), max(1, FILE_BYTES // most))
    return folder


def parse_archive(data: memoryview) -> Iterator[dict]:
    """Index entries of an archive, with the digest computed from the stored payload."""
    whole, at = bytes(data), 0
    while at < len(whole):
        blank = whole.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in whole[at:blank].decode().split("\r\n")[1:])
        start, size = blank + 4, int(fields["Content-Length"])
        inner = whole.index(b"\r\n\r\n", start)
        http = dict(line.split(": ", 1) for line in whole[start:inner].decode().split("\r\n")[1:])
        payload = whole[inner + 4 : start + size]
        response = fields["WARC-Type"] == "response"
        page, refers = fields.get("WARC-Page-Id"), fields.get("WARC-Refers-To-Page-Id")
        yield {
            "url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": page and int(page),
            "record_type": fields["WARC-Type"], "payload_bytes": len(payload) if response else int(http["Content-Length"]),
            "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": refers and int(refers), "offset": at, "length": start + size - at,
        }
        at = start + size + 4


def url_key(url: str | None) -> str:
    """Host labels from the top domain down, then the path: sites and their pages sort together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    ends = [at for at in (rest.find(sign) for sign in "/?#") if at >= 0]
    cut = min(ends, default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def order_of(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"], entry["captured"], page is None, page or 0


_INDEX = pa.schema([
    ("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
])
_INDEX_DDL = (
    "run string, url_key string, captured string, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, offset long, length long"
)


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index of each archive file, sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                run = sorted(parse_archive(memoryview(content.as_buffer())), key=order_of)
                yield pa.RecordBatch.from_pylist([entry | {"run": path.as_py()} for entry in run], schema=_INDEX)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter("length > 0")
    return files.select("path", "content").mapInArrow(work, _INDEX_DDL)


def merged(runs: Sequence[list[tuple]]) -> Iterator[tuple]:
    """Sorted lists in one order, by a loser tree.

    Every inner node keeps the loser of its match, so taking the winner replays only the
    matches on its way to the root. Runs that are used up lose to all others."""
    k = len(runs)
    if not k:
        return
    places = [0] * k

    def beats(a: int, b: int) -> bool:
        if places[a] >= len(runs[a]) or places[b] >= len(runs[b]):
            return places[a] < len(runs[a])
        left, right = runs[a][places[a]], runs[b][places[b]]
        return left < right or left == right and a < b

    losers = [-1] * k
    winner = -1
    for run in range(k):  # play each leaf up to the first node without a waiting loser
        node, best = (run + k) // 2, run
        while node and losers[node] >= 0:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2
        if node:
            losers[node] = best
        else:
            winner = best
    while places[winner] < len(runs[winner]):
        yield runs[winner][places[winner]]
        places[winner] += 1
        node, best = (winner + k) // 2, winner
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2
        winner = best


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in the order of (URL key, capture time, page id), range by range.

    Ranges follow all three columns, so the history of one frequent URL is cut by time."""
    total = runs.count()
    order = ["url_key", "captured", F.col("page_id").asc_nulls_last()]
    ranges = runs.repartitionByRange(max(1, math.ceil(total / ENTRIES)), *order).sortWithinPartitions("run", *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        rows: list[dict] = []
        for batch in batches:  # about ENTRIES narrow rows
            for entry in batch.to_pylist():
                held.setdefault(entry["run"], []).append((*order_of(entry), len(rows)))
                rows.append(entry)
        out = [rows[item[-1]] for item in merged(list(held.values()))]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=_INDEX)

    return ranges.mapInArrow(work, _INDEX_DDL)


def capture_index(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged index."""
    folder = write_archives(pages, **columns)
    return merge_runs(shared_table(sorted_runs(pages.sparkSession, folder), "runs"))


#: The digest columns in DuckDB.
SQL = r"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
