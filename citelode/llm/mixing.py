"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its share of the mix, held below ``most`` times what it has. The whole part of
target / size is certain copies of every document; the words still open are filled by a sample. Documents
are drawn with unequal probabilities, in proportion to their size among those of about their size (a
factor of ``CLASS_BITS`` bits): they are ranked by random odds over inclusion odds, and of each size class the
best ranked are taken, as many as the class's part of the open words holds. Classes go from long to short documents, so that
what a long document leaves open or would overfill is made up by shorter ones, and a class gives more
than its part if the shorter ones together could not. One more document, the one nearest to the
words still open, closes the gap.

Random numbers are digests of the id, so reruns and recomputed tasks agree.

Defined cases: a null text has size 0 and is taken 0 words, as are empty ones; null is a source
of its own, last in the order; a null id draws like any other id. Rows that repeat a document
tie in rank and are told apart by nothing, so they are taken together or not at all when
the boundary falls between them. Sources of size 0 have target 0. Empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.llm.common import WORD, same, whole_text
from citelode.session import shared_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Bits of a size that one class spans, and the largest inclusion probability that is drawn with.
CLASS_BITS, SUREST = 2, 0.95
#: 2^52, the digest bits used for a random number.
GRAIN = 4503599627370496


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number inside (0, 1) from the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(GRAIN)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, n_docs, source_size, target``: one row per source.

    Targets are level * weight up to the bound ``most`` * size. The level is found by
    ordering sources by the level at which they reach their bound: those before a source
    are full, the rest share what is left by weight."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    bound = (F.col("source_size") * most).cast("double")
    every = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    levels = weighed.withColumn("bound", bound).withColumn("full_at", F.col("bound") / F.col("weight")).select(
        "*", F.sum("source_size").over(all_rows).alias("all_size"),
        F.coalesce(F.sum("bound").over(before), F.lit(0.0)).alias("full"), F.sum("weight").over(after).alias("open_weight"),
    )
    level = (F.least(F.col("all_size") * share, F.col("all_size") * float(most)) - F.col("full")) / F.col("open_weight")
    fits = levels.withColumn("level", F.when(level <= F.col("full_at"), level))
    chosen = F.coalesce(F.max("level").over(all_rows), F.max("full_at").over(all_rows))
    target = F.least(F.col("bound"), chosen * F.col("weight"))
    return fits.select("source", "n_docs", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """1 for the shortest documents; each class spans ``CLASS_BITS`` bits of the size. Empty ones have none."""
    return F.when(size > 0, F.floor((F.length(F.bin(size)) + (CLASS_BITS - 1)) / CLASS_BITS)).otherwise(0).cast("int")


def class_table(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source and class: its documents and words, the words of all shorter classes, and what the
    source's table says."""
    summed = sizes.filter("size > 0").groupBy("source", size_class(F.col("size")).alias("class")).agg(
        F.count(F.lit(1)).alias("n_class"), F.sum("size").alias("class_words")
    )
    shorter = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.coalesce(F.sum("class_words").over(shorter), F.lit(0)).alias("rest_words")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = targets.withColumn("certain", F.floor(times)).withColumn("chance", times - F.col("certain"))
    known = known.withColumn("open", F.col("target") - F.col("certain") * F.col("source_size"))
    left = known.withColumnRenamed("source", "_source")
    joined = left.join(summed.select("*", rest), same(F.col("_source"), F.col("source")), "left").drop("source")
    return joined.withColumn("_class", F.coalesce("class", F.lit(0))).drop("class")


def ranked(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with the Pareto rank variable inside their class.

    ``rank`` is x / (1 + x), where x is the ratio of odds times the odds of the source's fraction: an
    increasing function of the ratio that is spread about evenly over (0, 1), so that slices of it hold like numbers
    of documents, about the square root of the class's."""
    rows = sizes.withColumn("class", size_class(F.col("size")))
    rows = rows.join(classes, same(F.col("source"), F.col("_source")) & (F.col("class") == F.col("_class")), "left").drop("_source", "_class")
    chance, u = F.col("chance"), F.col("draw")
    pi = F.least(F.lit(SUREST), chance * F.col("size") / (F.col("class_words") / F.col("n_class")))
    x = (u / (1.0 - u)) * (chance / (1.0 - chance)) / (pi / (1.0 - pi))
    rows = rows.withColumn("rank", F.when((chance > 0) & (F.col("size") > 0), x / (1.0 + x)).otherwise(1.0))
    return rows.withColumn("slice", F.floor(F.col("rank") * F.ceil(F.sqrt("n_class"))))


@dataclass(frozen=True)
class Mix:
    """What decides how often a document is taken: tables with one row per source, or per source and class.

    They are written, so Spark knows their size and broadcasts them if they are small."""

    targets: DataFrame
    classes: DataFrame
    marks: DataFrame
    closing: DataFrame

    def decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``doc_id, source, size, draw`` and more) with ``source_size, target, copies``."""
        joined = _drawn(ranked(rows, self.classes), self.marks)
        joined = joined.join(self.closing, same(F.col("source"), F.col("_source")), "left").drop("_source")
        known = self.targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"))
        joined = joined.drop("source_size", "target").join(known, same(F.col("source"), F.col("_source")), "left")
        closes = F.col("best").isNotNull() & same(F.col("best.id"), F.col("doc_id")) & (F.col("best.rank") == F.col("rank")) & (F.col("best.size") == F.col("size"))
        extra = F.when(F.col("drawn") | closes, 1).otherwise(0)
        return joined.select(
            *rows.columns, F.col("_size").alias("source_size"), F.col("_target").alias("target"),
            (F.coalesce("certain", F.lit(0)) + extra).cast("long").alias("copies"),
        )


def _place() -> Column:
    return F.struct("rank", F.col("doc_id").isNull().alias("no_id"), "doc_id")


def _drawn(rows: DataFrame, marks: DataFrame) -> DataFrame:
    joined = rows.join(marks, same(F.col("source"), F.col("_source")) & (F.col("class") == F.col("_class")), "left").drop("_source", "_class")
    return joined.withColumn("drawn", F.coalesce((F.col("chance") > 0) & (_place() <= F.col("last")), F.lit(False)))


def running_words(rows: DataFrame) -> DataFrame:
    """``source, class, through`` and the place of every document that can be drawn: words of its class up to it, in rank
    order. Slices are summed first, then only rows inside one slice are put in order, so a source with a
    third of all rows is spread over many tasks."""
    key = ["source", "class", "slice"]
    earlier = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*key).agg(F.sum("size").alias("words")).select(
        F.col("source").alias("_source"), F.col("class").alias("_class"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"),
    )
    met = same(F.col("source"), F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("slice") == F.col("_slice"))
    order = Window.partitionBy(*key).orderBy("rank", F.col("doc_id").asc_nulls_last())
    through = (F.col("earlier") + F.sum("size").over(order)).alias("through")
    return rows.join(shared_table(slices, "slices"), met).select("source", "class", "class_words", "rest_words", "size", _place().alias("place"), through)


def plan_mix(sizes: DataFrame) -> Mix:
    """Decide a mix from ``doc_id, source, size, draw`` (materialised). The classes are filled one after another,
    a dozen at most for documents of up to 2^24 words; each reads its own rows of the running words."""
    targets = shared_table(source_targets(sizes).coalesce(1), "targets")
    classes = shared_table(class_table(sizes, targets).coalesce(1), "classes")
    rows = ranked(sizes, classes).filter("chance > 0 AND size > 0")
    running = shared_table(running_words(rows), "running")
    left = classes.groupBy("_source").agg(F.max("open").alias("remaining"))
    marks = None
    for number in sorted((row[0] for row in classes.select("_class").distinct().collect() if row[0] > 0), reverse=True):
        own = running.filter(F.col("class") == number)
        met = left.join(own, same(F.col("source"), F.col("_source")))
        part = F.col("remaining") * F.col("class_words") / (F.col("class_words") + F.col("rest_words"))
        needed = F.col("remaining") - F.col("rest_words")
        # The class's part, or as much more as the shorter classes cannot give.
        down = F.max(F.when(F.col("through") <= part, F.struct("through", "place")))
        up = F.min(F.when((F.col("through") >= needed) & (F.col("through") <= F.col("remaining")), F.struct("through", "place")))
        found = met.groupBy("_source", "remaining").agg(down.alias("down"), up.alias("up"), F.max(needed).alias("needed"))
        taken = F.when(F.coalesce(F.col("down.through"), F.lit(0)) >= F.col("needed"), F.col("down")).otherwise(F.coalesce("up", "down"))
        chosen = shared_table(found.select("_source", taken.alias("taken")).filter("taken IS NOT NULL").coalesce(1), "class")
        mark = chosen.select("_source", F.lit(number).alias("_class"), F.col("taken.place").alias("last"))
        marks = mark if marks is None else marks.unionByName(mark)
        step = chosen.select(F.col("_source").alias("_taken_source"), F.col("taken.through").alias("through"))
        left = left.join(step, same(F.col("_source"), F.col("_taken_source")), "left").select(
            "_source", (F.col("remaining") - F.coalesce("through", F.lit(0))).alias("remaining")
        )
        left = shared_table(left.coalesce(1), "left")
    if marks is None:
        marks = running.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.col("place").alias("last")).limit(0)
    marks = shared_table(marks.coalesce(1), "marks")
    gaps = left.select(F.col("_source").alias("_gap_source"), F.col("remaining").alias("gap"))
    open_rows = _drawn(rows, marks).filter("NOT drawn").join(gaps, same(F.col("source"), F.col("_gap_source")))
    miss = F.abs(F.col("gap") - F.col("size"))
    nearest = F.min(F.struct(miss.alias("miss"), "rank", F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "size"))
    closing = open_rows.filter(miss < F.col("gap")).groupBy("source").agg(nearest.alias("best"))
    closing = shared_table(closing.select(F.col("source").alias("_source"), "best").coalesce(1), "closing")
    return Mix(targets, classes, marks, closing)


def _sized(doc_id: str, text: str, source: str) -> list[Column]:
    return [
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(whole_text(text)).alias("size"), draw(F.col(doc_id)).alias("draw"),
    ]


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, draw, source_size, target, copies`` for every row."""
    sizes = shared_table(docs.select(*_sized(doc_id, text, source)), "sizes")
    return plan_mix(sizes).decide(sizes)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns as they were. The texts
    stay where they are; only the tables by source come to them."""
    plan = plan_mix(shared_table(docs.select(*_sized(doc_id, text, source)), "sizes"))
    wide = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_llm_doc"), *_sized(doc_id, text, source))
    taken = plan.decide(wide).filter("copies > 0")
    every = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_llm_copy")
    return taken.select("_llm_doc", every).select("_llm_doc.*")


#: The same mix in DuckDB.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS draw
  FROM documents),
totals AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes GROUP BY source),
bounds AS (SELECT *, (source_size * 2)::DOUBLE AS bound, (source_size * 2)::DOUBLE / weight AS full_at FROM totals),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size,
    coalesce(sum(bound) OVER (ORDER BY full_at, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_words,
    sum(weight) OVER (ORDER BY full_at, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM bounds),
fits AS (SELECT *, (all_size::DOUBLE * 1.5::DOUBLE - full_words) / open_weight AS level FROM levels),
targets AS (
  SELECT source, n_docs, source_size,
    least(bound, coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), max(full_at) OVER ()) * weight) AS target
  FROM fits),
sized AS (
  SELECT *, CASE WHEN size > 0 THEN ((length(bin(size)) + 1) // 2)::INT ELSE 0 END AS class FROM sizes),
class_sums AS (SELECT source, class, count(*) AS n_class, sum(size)::BIGINT AS class_words FROM sized WHERE class > 0 GROUP BY ALL),
classes AS (
  SELECT *, coalesce(sum(class_words) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_words
  FROM class_sums),
chances AS (
  SELECT *, times - certain AS chance, target - certain * source_size AS open_words FROM (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS times,
      floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) AS certain FROM targets)),
inclusion AS (
  SELECT s.*, c.source_size, c.target, c.certain, c.chance, k.n_class, k.class_words, k.rest_words,
    least(0.95::DOUBLE, c.chance * s.size / (k.class_words / k.n_class)) AS pi
  FROM sized s JOIN chances c ON s.source IS NOT DISTINCT FROM c.source
    LEFT JOIN classes k ON k.source IS NOT DISTINCT FROM s.source AND k.class = s.class),
ratios AS (SELECT *, (draw / (1.0::DOUBLE - draw)) * (chance / (1.0::DOUBLE - chance)) / (pi / (1.0::DOUBLE - pi)) AS x FROM inclusion),
placed AS (SELECT *, CASE WHEN chance > 0 AND size > 0 THEN x / (1.0::DOUBLE + x) ELSE 1.0::DOUBLE END AS rank_value FROM ratios),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source, class ORDER BY rank_value, doc_id NULLS LAST)::BIGINT AS through FROM placed WHERE chance > 0 AND size > 0),
step0 AS (SELECT source, open_words AS remaining FROM chances),
{steps}
marks AS ({marks}),
drawn AS (
  SELECT p.*, coalesce(r.through <= m.taken, false) AS is_drawn
  FROM placed p LEFT JOIN (SELECT DISTINCT source, class, rank_value, doc_id, through FROM running) r
    ON r.source IS NOT DISTINCT FROM p.source AND r.class = p.class AND r.rank_value = p.rank_value AND r.doc_id IS NOT DISTINCT FROM p.doc_id AND p.chance > 0
    LEFT JOIN marks m ON m.source IS NOT DISTINCT FROM p.source AND m.class = p.class),
gaps AS (SELECT d.*, s.remaining AS gap FROM drawn d JOIN {last} s ON s.source IS NOT DISTINCT FROM d.source),
closing AS (
  SELECT *, chance > 0 AND size > 0 AND NOT is_drawn AND abs(gap - size) < gap AS can_close,
    row_number() OVER (PARTITION BY source ORDER BY (chance > 0 AND size > 0 AND NOT is_drawn AND abs(gap - size) < gap) DESC, abs(gap - size), rank_value, doc_id NULLS LAST) = 1 AS nearest
  FROM gaps)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (certain + CASE WHEN is_drawn OR (can_close AND nearest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM closing
"""

#: Classes that the SQL steps through: documents of up to 2^32 words.
_CLASSES = range(16, 0, -1)


def _step(number: int, place: int) -> str:
    """SQL of one class: what it takes of the remaining words of each source."""
    return f"""pick{number} AS (
  SELECT r.source, r.remaining, max(u.through) FILTER (u.through <= r.remaining * u.class_words / (u.class_words + u.rest_words)) AS down,
    min(u.through) FILTER (u.through >= r.remaining - u.rest_words AND u.through <= r.remaining) AS up, max(r.remaining - u.rest_words) AS needed
  FROM step{place} r LEFT JOIN running u ON u.source IS NOT DISTINCT FROM r.source AND u.class = {number} GROUP BY r.source, r.remaining),
take{number} AS (
  SELECT *, CASE WHEN needed IS NULL THEN NULL WHEN coalesce(down, 0) >= needed THEN down ELSE coalesce(up, down) END AS taken FROM pick{number}),
step{place + 1} AS (SELECT source, remaining - coalesce(taken, 0) AS remaining FROM take{number}),"""


SQL = SQL.format(
    steps="\n".join(_step(number, place) for place, number in enumerate(_CLASSES)),
    marks=" UNION ALL ".join(f"SELECT source, {number} AS class, taken FROM take{number} WHERE taken IS NOT NULL" for number in _CLASSES),
    last=f"step{len(_CLASSES)}",
)
