"""Building and checking question sets."""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators.keyword import top_k
from citelode.operators.scan import (
    blocked_last_value, blocked_row_number, hash_block, hash_order, integer_block,
)
from citelode.operators.sizing import lookup_join, small_side
from citelode.session import cut_lineage

# Fixed values -------------------------------------------------------------------
DIFFICULTIES = ("easy", "medium", "hard")
KINDS = ("standard", "multi_source", "unanswerable")
GRAM = 6
MIN_RUN = 8
MIN_PAGES = 3
REPEAT_SHARE = 0.3
PAIR_BAND = (2, 12)
#: Hashes of grams that a task counts; the tasks follow the input, their memory does not.
GRAM_ROWS = 1_000_000
# --------------------------------------------------------------------------------


def stratified_split(items: DataFrame, strata: list[str], fraction: float, seed: int, key: str = "id") -> DataFrame:
    """Every item with ``half`` = validation or holdout.

    Strata in sorted order share out the fraction, remainders carried forward, so the
    overall share is exact. Within a stratum items go in a seeded hash order, numbered
    block by block. The carried remainder runs over strata counts only.
    """
    digest = hash_order(F.lit(seed), *[F.col(s) for s in strata], F.col(key))
    ordered = items.withColumn("__digest", digest).withColumn("__block", hash_block(F.col("__digest")))
    numbered = blocked_row_number(ordered, strata, "__block", [F.col("__digest"), F.col(key)], "__no")
    sizes = items.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(
        Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    quota = sizes.withColumn("__upto", upto).select(
        *strata,
        (F.floor(F.col("__upto") * fraction) - F.floor((F.col("__upto") - F.col("__n")) * fraction)).alias("__take"),
    )
    return lookup_join(numbered, quota, strata).withColumn(
        "half", F.when(F.col("__no") <= F.col("__take"), "validation").otherwise("holdout")
    ).drop("__digest", "__block", "__no", "__take")


def strip_boilerplate(
    pages: DataFrame, min_pages: int = MIN_PAGES, share: float = REPEAT_SHARE
) -> DataFrame:
    """Drop text that recurs across a category's pages. ``pages``: id, category, text.

    Word 6-grams found on many pages of the category mark their words; runs of at least
    eight unmarked words survive. Categories with too few pages pass unchanged.
    """
    sizes = pages.groupBy("category").agg(F.count(F.lit(1)).alias("n_pages"))
    sized = lookup_join(pages, sizes, ["category"])
    small = sized.filter(F.col("n_pages") < min_pages).select("id", "category", "text")
    # Pages whose text is blank keep one row with no words.
    words = sized.filter(F.col("n_pages") >= min_pages).select(
        "id", "category", "n_pages", F.split(T.strip(F.col("text")), T.SPACES).alias("words")
    )
    starts = F.when(
        F.size("words") >= GRAM, F.sequence(F.lit(0), F.size("words") - GRAM)
    ).otherwise(F.array().cast("array<int>"))
    grams = words.select(
        "id", "category", "n_pages",
        F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, GRAM), " ")).alias("grams"),
    )
    # A page counts once per gram. Hashes are counted first, eight bytes each and without map-side sums, which nearly
    # only hold grams that never repeat; the grams of frequent hashes, all frequent grams among them, are then counted as they are.
    need = F.greatest(F.lit(float(min_pages)), F.col("n_pages") * share)
    hashes = F.array_distinct(F.transform("grams", lambda gram: F.xxhash64("category", gram)))
    # Checkpointed, because their sizes are looked at before they are joined.
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    frequent = cut_lineage(
        T.each(grams, [need.alias("need")], hashes, "hash").repartition(1 + total // GRAM_ROWS, "hash")
        .groupBy("hash", "need").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("need")).select("hash").distinct()
    )
    each = T.each(grams, ["category", need.alias("need")], F.array_distinct("grams"), "gram").withColumn("hash", F.xxhash64("category", "gram"))
    repeated = cut_lineage(
        lookup_join(each, frequent, ["hash"]).groupBy("category", "need", "gram").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.col("need")).select("category", "gram")
    )
    marked = lookup_join(
        T.each(grams, ["id", "category"], F.col("grams"), "start", "gram"), repeated, ["category", "gram"]
    ).groupBy("id").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    # What lies between one marked gram and the next, both ends of the page included.
    before = F.concat(F.array(F.lit(0)), F.transform("starts", lambda start: start + GRAM))
    gaps = F.arrays_zip(before.alias("start"), F.concat("starts", F.array(F.size("words"))).alias("end"))
    runs = F.transform(
        F.filter(gaps, lambda gap: gap["end"] - gap["start"] >= MIN_RUN),
        lambda gap: F.array_join(F.slice("words", gap["start"] + 1, gap["end"] - gap["start"]), " "),
    )
    marks = F.coalesce("starts", F.array().cast("array<int>")).alias("starts")
    cleaned = words.join(marked, "id", "left").select("id", "category", "words", marks).select(
        "id", "category", F.array_join(runs, "\n\n").alias("text")
    )
    return small.unionByName(cleaned)


def partner_pages(seeds: DataFrame, pages: DataFrame, band: tuple[int, int] = PAIR_BAND) -> DataFrame:
    """Pages of the seed's category from other files, ranked by shared distinct words;
    the middle band is kept. ``seeds``: seed, category, file, words. ``pages``: id,
    category, file, words. Seeds are a drawn sample and are size-checked."""
    drawn = small_side(seeds.select(F.col("seed"), "category", F.col("file").alias("seed_file"), F.col("words").alias("seed_words")))
    shared = F.size(F.array_intersect("words", "seed_words")).alias("shared")
    pairs = pages.join(drawn, "category").filter(F.col("file") != F.col("seed_file")).select("seed", "id", shared)
    ranked = top_k(pairs, ["seed"], [F.col("shared").desc(), F.col("id")], band[1])
    return ranked.filter(F.col("rank") > band[0])


def draw_pages(pages: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` pages per category: numeric pages before others, then spread over files in
    a seeded order. No more than ``k`` pages of a file can be drawn, so each file is cut
    to that before the spread."""
    ordered = pages.withColumn("__digest", hash_order(F.lit(seed), F.col("id")))
    per_file = top_k(
        ordered, ["category", "file", "has_numbers"], [F.col("__digest"), F.col("id")], k, "turn"
    )
    order = [F.col("has_numbers").desc(), F.col("turn"), F.col("__digest"), F.col("id")]
    return top_k(per_file, ["category"], order, k, "draw").drop("__digest")


#: Kinds of sampler events: draw a page, draw one with numbers if there is one, put a page back.
DRAW, DRAW_NUMBERS, RELEASE = "draw", "draw_numbers", "release"


class _Pool:
    """Pages of a category that can be drawn, found by the uses of their file and then in digest order.

    A queue for all pages and one for those with numbers hold one valid entry (uses, first free page) for every file.
    It may be too low, since a draw only raises both; it is put right when it comes to the top. What lowers
    them, ``put`` and ``lowered``, enters a new one. So an event costs logarithms, not a look at every page."""

    def __init__(self, files: list, numbers: list[bool], free: list[bool], uses: dict):
        self.files, self.numbers, self.free, self.uses = files, numbers, free, uses
        self.queues: tuple[list, list] = ([], [])
        self.valid: tuple[dict, dict] = ({}, {})
        self.heaps: tuple[dict, dict] = ({}, {})
        for at, file in enumerate(files):
            for only in range(1 + numbers[at]):
                self.heaps[only].setdefault(file, []).append(at)
        for only, heaps in enumerate(self.heaps):
            for file in heaps:
                self._enter(only, file)

    def _first(self, only: int, file: object) -> int | None:
        heap = self.heaps[only].get(file, [])
        while heap and not self.free[heap[0]]:
            heappop(heap)
        return heap[0] if heap else None

    def _enter(self, only: int, file: object) -> None:
        first = self._first(only, file)
        if first is not None:
            entry, known = (self.uses.get(file, 0), first), self.valid[only].get(file)
            if known is None or entry < known:
                self.valid[only][file] = entry
                heappush(self.queues[only], entry)

    def best(self, only: int) -> int | None:
        """The page to draw, of those with numbers if ``only``; null if there is none."""
        queue, valid = self.queues[only], self.valid[only]
        while queue:
            file = self.files[queue[0][1]]
            if valid.get(file) != queue[0]:
                heappop(queue)
                continue
            first = self._first(only, file)
            if first is None:
                del valid[file]
                heappop(queue)
                continue
            entry = (self.uses.get(file, 0), first)
            if entry == queue[0]:
                return first
            valid[file] = entry
            heapreplace(queue, entry)
        return None

    def take(self, at: int) -> None:
        self.free[at] = False

    def put(self, at: int) -> None:
        if not self.free[at]:
            self.free[at] = True
            for only in range(1 + self.numbers[at]):
                heappush(self.heaps[only][self.files[at]], at)
                self._enter(only, self.files[at])

    def lowered(self, file: object) -> None:
        """The file has fewer uses than before."""
        for only in (0, 1):
            self._enter(only, file)


def replay_draws(pages: list[tuple], events: list[tuple]) -> list[tuple]:
    """Outcome of a category's events in order: ``(seq, id, relaxed)`` for every event, id null where nothing is left.

    ``pages``: (file, digest, id, has_numbers), ``events``: (seq, kind, cell, drawn_by) in order. A draw takes an unused
    page of a file with the fewest uses, first in digest order. If all pages are used, one that the event's own cell has not
    used is taken again (relaxed). A release puts back the page that the event ``drawn_by`` got. A cell gets a pool of
    its own with its first relaxed draw; cells are few."""
    pages = sorted(pages, key=lambda page: (page[1], page[2]))
    files, numbers = [page[0] for page in pages], [bool(page[3]) for page in pages]
    rows: dict = {}
    for at, page in enumerate(pages):
        rows.setdefault(page[2], []).append(at)
    uses: dict = {}
    cells: dict = {}
    got: dict = {}
    unused = _Pool(files, numbers, [True] * len(pages), uses)
    pools: dict = {}
    out = []
    for seq, kind, cell, drawn_by in events:
        if kind == RELEASE:
            at, drawer = got.pop(drawn_by, (None, None))
            if at is None:
                out.append((seq, None, False))
                continue
            cells[drawer].discard(pages[at][2])
            uses[files[at]] = max(0, uses[files[at]] - 1)
            for row in rows[pages[at][2]]:
                unused.put(row)
                if drawer in pools:
                    pools[drawer].put(row)
            for pool in (unused, *pools.values()):
                pool.lowered(files[at])
            out.append((seq, pages[at][2], False))
            continue
        pool, relaxed = unused, unused.best(0) is None
        if relaxed:
            if cell not in pools:
                pools[cell] = _Pool(files, numbers, [page[2] not in cells.get(cell, ()) for page in pages], uses)
            pool = pools[cell]
        at = pool.best(1) if kind == DRAW_NUMBERS else None
        at = pool.best(0) if at is None else at
        if at is not None:
            for row in rows[pages[at][2]]:
                unused.take(row)
                if cell in pools:
                    pools[cell].take(row)
            cells.setdefault(cell, set()).add(pages[at][2])
            uses[files[at]] = uses.get(files[at], 0) + 1
            got[seq] = (at, cell)
        out.append((seq, None if at is None else pages[at][2], relaxed and at is not None))
    return out


def sampler_state(pages: DataFrame, events: DataFrame, seed: int, excluded_ids: DataFrame | None = None) -> DataFrame:
    """Draws and releases of every category in order of ``seq``: ``category, seq, id, relaxed``.

    ``pages``: category, file, id, has_numbers. ``events``: category, seq, kind, cell, drawn_by (the seq whose page is
    put back). ``excluded_ids``: pages that are never drawn. With E draws a category can reach at most the first E
    pages of a file (E with and E without numbers) and, of these, files whose first page is among the first E in digest
    order, so its task gets that many rows and not the category; where draws outnumber the pages that is all of them."""
    left = pages if excluded_ids is None else pages.join(small_side(excluded_ids.select("id").distinct()), "id", "left_anti")
    draws = events.groupBy("category").agg(F.count_if(F.col("kind") != RELEASE).alias("__draws"))
    marked = left.join(small_side(draws), "category").withColumn("__digest", hash_order(F.lit(seed), F.col("id")))
    order = [F.col("__digest"), F.col("id")]
    turns = marked.withColumn("__turn", F.row_number().over(Window.partitionBy("category", "file", "has_numbers").orderBy(*order)))
    near = turns.filter(F.col("__turn") <= F.col("__draws"))
    heads = near.filter("__turn = 1").withColumn("__head", F.row_number().over(Window.partitionBy("category", "has_numbers").orderBy(*order)))
    files = heads.filter(F.col("__head") <= F.col("__draws")).select("category", "file").distinct()
    reachable = near.join(small_side(files), ["category", "file"], "left_semi").select("category", "file", "__digest", "id", "has_numbers")
    kinds = dict(pages.dtypes)

    def replay(key: tuple, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("seq")
        steps = [(int(a), b, c, None if pd.isna(d) else int(d)) for a, b, c, d in asked[["seq", "kind", "cell", "drawn_by"]].itertuples(index=False)]
        found = replay_draws(list(mine[["file", "__digest", "id", "has_numbers"]].itertuples(index=False, name=None)), steps)
        out = pd.DataFrame(found, columns=["seq", "id", "relaxed"])
        out["id"] = out["id"].astype("Int64") if kinds["id"] == "bigint" else out["id"]
        return out.assign(category=key[0])[["category", "seq", "id", "relaxed"]]

    shape = f"category {kinds['category']}, seq long, id {kinds['id']}, relaxed boolean"
    return reachable.groupBy("category").cogroup(events.groupBy("category")).applyInPandas(replay, shape)


def excluded(items: DataFrame, held_out: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items free of held-out pages, and the leaking ones."""
    lookup = small_side(held_out.select(*on).distinct())
    return items.join(lookup, on, "left_anti"), items.join(lookup, on, "left_semi")


def cell_problems(items: DataFrame, expected: dict[str, dict[str, int]], categories: DataFrame) -> DataFrame:
    """Cells whose number of items is off. ``expected``: kind to difficulty to count.
    ``categories``: domain, all that there should be; one without items is off in every cell, and
    so is an item's domain that is not among them. The rest is a closed list, so nothing is crossed."""
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(d).alias("difficulty"), F.lit(n).alias("expected"))
            for k, row in expected.items() for d, n in row.items()
        ]
    )
    known = categories.select("domain").union(items.select("domain")).distinct()
    cells = known.select("domain", F.inline(wanted))
    have = items.groupBy("domain", "kind", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(have, ["domain", "kind", "difficulty"], "left").select(
        "domain", "kind", "difficulty", F.coalesce("n", F.lit(0)).alias("n"), F.col("expected").cast("long").alias("expected"),
    ).filter(F.col("n") != F.col("expected"))


def missing_slots(items: DataFrame, expected: dict[str, dict[str, int]], categories: DataFrame) -> DataFrame:
    """One row per slot a category still lacks, categories without items included."""
    short = cell_problems(items, expected, categories).filter(F.col("n") < F.col("expected"))
    return short.select("domain", "kind", "difficulty", F.explode(F.sequence(F.lit(1), (F.col("expected") - F.col("n")).cast("int"))).alias("slot"))


def reused_pages(citations: DataFrame, cell: list[str], page: list[str]) -> DataFrame:
    """Items that cite a page an earlier item of the cell already cites, with that item.
    A page cited by very many items is walked in blocks."""
    blocked = citations.withColumn("__block", integer_block(F.col("id")))
    previous = blocked_last_value(blocked, [*cell, *page], "__block", [F.col("id")], F.col("id"), "used_by")
    return previous.filter(F.col("used_by").isNotNull()).drop("__block")


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def shape_problems(items: DataFrame) -> DataFrame:
    """Items that break their kind's rules. ``items``: id, kind, difficulty, answerable,
    n_groups, n_files."""
    k, groups = F.col("kind"), F.col("n_groups")
    problem = (
        F.when((k == "unanswerable") & (F.col("answerable") | (groups > 0)), "unanswerable_with_sources")
        .when((k != "unanswerable") & ~F.col("answerable"), "must_be_answerable")
        .when((k == "standard") & (groups != 1), "standard_needs_one_group")
        .when((k == "multi_source") & (groups != 2), "multi_source_needs_two_groups")
        .when((k == "multi_source") & (F.col("difficulty") != "hard"), "multi_source_must_be_hard")
        .when((k == "multi_source") & (F.col("n_files") < 2), "multi_source_needs_two_files")
    )
    return items.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def corpus_coverage(citations: DataFrame) -> DataFrame:
    """Per domain: items, distinct files and pages, files used more than twice.
    ``citations``: domain, id, file, page. Counted in levels, so no domain is collected."""
    uses = citations.groupBy("domain", "file", "page").agg(F.count(F.lit(1)).alias("n"))
    files = uses.groupBy("domain", "file").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("uses"))
    per_domain = files.groupBy("domain").agg(
        F.count(F.lit(1)).alias("distinct_files"), F.sum("pages").alias("distinct_pages"),
        F.count_if(F.col("uses") > 2).alias("overused_files"),
    )
    items = citations.groupBy("domain", "id").agg(F.lit(1).alias("one")).groupBy("domain").agg(F.count(F.lit(1)).alias("items"))
    return items.join(per_domain, "domain")


def first_failed_gate(items: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Each item with the first gate it fails, in gate order; null when it passes."""
    failed = F.lit(None).cast("string")
    for name, passes in reversed(gates):
        failed = F.when(~passes, name).otherwise(failed)
    return items.withColumn("failed_gate", failed)
