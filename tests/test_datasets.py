import random
from collections import Counter

from pyspark.sql import functions as F

from citelode.operators import datasets as X
from citelode.operators import history as H
from citelode.operators import near_duplicates as N


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def make_items(seed=1, n=400):
    """A third are exact copies of one text, a quarter near copies of another."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base, near = rng.sample(words, 40), rng.sample(words, 40)
    items = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            tokens = list(base)
        elif kind < 0.6:
            tokens = [w if rng.random() > 0.15 else rng.choice(words) for w in near]
        elif kind < 0.65:
            tokens = []
        else:
            tokens = rng.sample(words, rng.randint(1, 45))
        items.append((i, tokens))
    rng.shuffle(items)
    return items


def test_near_duplicates_match_brute_force(spark):
    items = make_items()
    ordered = sorted(items)
    expected = {}
    for i, tokens in ordered:
        first = next((j for j, other in ordered if j < i and jaccard(tokens, other) >= 0.6), None)
        if first is not None:
            expected[i] = first
    frame = spark.createDataFrame(items, "ord long, tokens array<string>").repartition(4)
    assert {r["ord"]: r["match"] for r in N.first_near_duplicates(frame).collect()} == expected
    assert len(expected) > 150


def test_near_duplicates_of_existing(spark):
    items, existing = make_items(2, 200), [(i, t) for i, t in make_items(2, 60)]
    expected = {}
    for i, tokens in items:
        hits = [j for j, other in existing if jaccard(tokens, other) >= 0.6]
        if hits:
            expected[i] = min(hits)
    schema = "ord long, tokens array<string>"
    found = N.first_near_duplicates(spark.createDataFrame(items, schema), spark.createDataFrame(existing, schema))
    assert {r["ord"]: r["match"] for r in found.collect()} == expected


def test_threshold_is_inclusive(spark):
    schema = "ord long, tokens array<string>"
    frame = spark.createDataFrame([(0, ["a", "b", "c", "d"]), (1, ["a", "b", "c", "e"]), (2, ["a", "b", "c", "d", "x"])], schema)
    assert {(r["ord"], r["match"]) for r in N.first_near_duplicates(frame).collect()} == {(1, 0), (2, 0)}


def test_near_duplicate_work_stays_linear_in_a_cluster(spark):
    """Candidates after the first guess must not pair a cluster with itself."""
    near = [f"n{i}" for i in range(50)]
    rows = [(i, [*near, f"u{i}"]) for i in range(600)]
    found = N.first_near_duplicates(spark.createDataFrame(rows, "ord long, tokens array<string>"))
    assert {r["match"] for r in found.collect()} == {0} and found.count() == 599


def carry_split(sizes, fraction):
    out, debt = {}, 0.0
    for key in sorted(sizes):
        exact = sizes[key] * fraction + debt
        out[key] = int(exact)
        debt = exact - out[key]
    return out


def test_split_carries_remainders(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcde"), rng.choice("xy")) for i in range(700)] + [(1000 + i, "hot", "x") for i in range(351)]
    frame = spark.createDataFrame(rows, "id long, s string, t string")
    out = X.stratified_split(frame, ["s", "t"], 0.5, 7)
    sizes = {}
    for _, s, t in rows:
        sizes[s, t] = sizes.get((s, t), 0) + 1
    got = {(r["s"], r["t"]): r["n"] for r in out.filter("half = 'validation'").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: v for k, v in carry_split(sizes, 0.5).items() if v}
    assert out.count() == len(rows)
    again = X.stratified_split(frame.repartition(3), ["s", "t"], 0.5, 7)
    assert again.exceptAll(out).count() == 0


def test_boilerplate(spark):
    chrome = "home about news contact imprint privacy terms help"
    bodies = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(4)]
    rows = [(i, "c", f"{chrome} {body} {chrome} end{i} of page") for i, body in enumerate(bodies)] + [(9, "tiny", f"{chrome} x")]
    out = {r["id"]: r["text"] for r in X.strip_boilerplate(spark.createDataFrame(rows, "id long, category string, text string")).collect()}
    assert [out[i] for i in range(4)] == bodies
    assert out[9] == f"{chrome} x"


def stripped_plainly(rows):
    out = {}
    for category in {row[1] for row in rows}:
        pages = [(i, text) for i, own, text in rows if own == category]
        if len(pages) < X.MIN_PAGES:
            out.update(pages)
            continue
        words = {i: text.split() for i, text in pages}
        grams = {i: [tuple(w[at:at + X.GRAM]) for at in range(len(w) - X.GRAM + 1)] for i, w in words.items()}
        seen = Counter(gram for own in grams.values() for gram in set(own))
        for i, w in words.items():
            marked = {at + k for at, gram in enumerate(grams[i]) if seen[gram] >= max(X.MIN_PAGES, X.REPEAT_SHARE * len(pages)) for k in range(X.GRAM)}
            runs, run = [], []
            for at in range(len(w) + 1):
                if at < len(w) and at not in marked:
                    run.append(w[at])
                elif run:
                    runs, run = runs + [run] * (len(run) >= X.MIN_RUN), []
            out[i] = "\n\n".join(map(" ".join, runs))
    return out


def test_boilerplate_without_a_row_per_word(spark, monkeypatch):
    monkeypatch.setattr(X, "GRAM_ROWS", 500)  # several tasks
    rng = random.Random(5)
    chrome = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)) for n in (6, 7, 11, 30)]
    rows = []
    for i in range(60):
        parts = [rng.choice(chrome) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 20))) for _ in range(rng.randrange(0, 7))]
        rows.append((i, ("big", "big", "mid", f"small{i // 9}")[i % 4], " ".join(" ".join(parts).split())))
    found = X.strip_boilerplate(spark.createDataFrame(rows, "id long, category string, text string"))
    assert {r["id"]: r["text"] for r in found.collect()} == stripped_plainly(rows)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_reuse_names_the_previous_item(spark):
    rows = [("d", 5, 1), ("d", 5, 5000), ("d", 5, 9000), ("d", 6, 2)]
    out = X.reused_pages(spark.createDataFrame(rows, "domain string, page long, id long"), ["domain"], ["page"])
    assert {(r["id"], r["used_by"]) for r in out.collect()} == {(5000, 1), (9000, 5000)}


def test_cells_and_slots(spark):
    rows = [(1, "car", "standard", "easy"), (2, "car", "standard", "easy"), (3, "life", "standard", "hard")]
    items = spark.createDataFrame(rows, "id long, domain string, kind string, difficulty string")
    expected = {"standard": {"easy": 2, "hard": 1}}
    problems = {(r["domain"], r["difficulty"], r["n"]) for r in X.cell_problems(items, expected, items).collect()}
    assert problems == {("car", "hard", 0), ("life", "easy", 0)}
    assert X.missing_slots(items, expected, items).count() == 3


def test_categories_without_items_are_reported(spark):
    items = spark.createDataFrame([(1, "car", "standard", "easy")], "id long, domain string, kind string, difficulty string")
    categories = spark.createDataFrame([("car",), ("life",)], "domain string")
    expected = {"standard": {"easy": 1}}
    assert [(r["domain"], r["n"]) for r in X.cell_problems(items, expected, categories).collect()] == [("life", 0)]
    assert [r["domain"] for r in X.missing_slots(items, expected, categories).collect()] == ["life"]


def test_near_duplicates_of_large_ids(spark):
    words = ["a", "b", "c"]
    items = spark.createDataFrame([(1, words)], "ord long, tokens array<string>")
    existing = spark.createDataFrame([(2**62 + 5, words), (2**62 + 9, words), (-(2**61), ["z"])], "ord long, tokens array<string>")
    found = N.first_near_duplicates(items, existing).collect()
    assert [(r["ord"], r["match"]) for r in found] == [(1, 2**62 + 5)]


def test_question_index_first_source_wins(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, ordinal int, q string")
    out = H.question_index([make([("a", 0, "one"), (None, 1, "x")]), make([("a", 0, "two"), ("b", 5, "late"), ("b", 1, "early")])])
    assert {(r["id"], r["q"]) for r in out.collect()} == {("a", "one"), ("b", "early")}


def test_history_page(spark):
    records = spark.createDataFrame([(i, f"r{i}") for i in range(1, 8)], "lineno int, pair_id string")
    questions = spark.createDataFrame([("r4", "q")], "pair_id string, question string")
    judgments = spark.createDataFrame([("r5", 1)], "pair_id string, grade int")
    rows = H.history_page(records, questions, judgments, 3, 2).orderBy("lineno").collect()
    assert [(r["pair_id"], r["question"], r["grade"], r["total"]) for r in rows] == [("r4", "q", None, 7), ("r5", None, 1, 7)]


def test_cache_status(spark):
    work = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, fingerprint string")
    cache = spark.createDataFrame([(1, "x"), (2, "old"), (9, "q")], "id int, fingerprint string")
    assert {r["id"]: r["status"] for r in H.cache_status(work, cache, ["id"]).collect()} == {1: "cached", 2: "stale", 3: "new"}
    assert [r["id"] for r in H.orphans(cache, work, ["id"]).collect()] == [9]


def test_near_duplicates_of_long_sets(spark, monkeypatch):
    """Prefixes of long pairs have to share several tokens, and frequent tokens are paired by block."""
    rng = random.Random(5)
    sets = []
    for i in range(160):
        base = set(rng.sample(range(700), rng.randint(40, 260)))
        if i > 20 and i % 2:
            base = set(sets[rng.randrange(i)])
            base -= set(rng.sample(sorted(base), int(len(base) * rng.choice([0.05, 0.2, 0.24, 0.26]))))
            base |= set(rng.sample(range(700), int(len(base) * rng.choice([0.0, 0.1, 0.25]))))
        sets.append(base)
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.6
    expected = {i: min((j for j in range(i) if alike(sets[i], sets[j])), default=None) for i in range(160)}
    expected = {i: j for i, j in expected.items() if j is not None}
    facing = {i: 1000 + min(j for j in range(160) if alike(sets[i], sets[j])) for i in range(160)}
    rows = lambda start: [(start + i, [f"w{t}" for t in s]) for i, s in enumerate(sets)]
    frame = lambda start: spark.createDataFrame(rows(start), "ord long, tokens array<string>")
    found = lambda *a: {r["ord"]: r["match"] for r in N.first_near_duplicates(*a).collect()}
    assert len(expected) > 20 and found(frame(0)) == expected and found(frame(0), frame(1000)) == facing
    monkeypatch.setattr(N, "HOT_MEMBERS", 20)
    assert found(frame(0)) == expected


def test_near_duplicate_prefixes_of_a_pair_meet_rarely(spark):
    """Of the meetings of unrelated sets on stored prefix tokens, few lie in both prefixes of the pair."""
    rng = random.Random(6)
    rows = [(i, [f"w{t}" for t in rng.sample(range(900), 100)], 100) for i in range(60)]
    classes = spark.createDataFrame(rows, "cid long, tokens array<string>, n int")
    frequency = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    keys = N._prefixes(classes, frequency, 0.6).localCheckpoint()
    other = keys.select("token", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"))
    met = keys.join(other, "token").filter("cid < other")
    inside = met.filter(N._in_prefix(F.col("n"), F.col("m"), F.col("at"), F.col("other_at"), 0.6)).count()
    assert 0 < inside * 3 < met.count() * 2


def test_candidates_are_counted_block_by_block(spark, monkeypatch):
    """Blocks and portions of any size give the pairs that share enough of their prefixes, and no pair moves before."""
    rng = random.Random(12)
    rows = [(i, [f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 60))]) for i in range(150)] + [(None, ["w1", "w2"])]
    keyed = N._keyed(spark.createDataFrame(rows, "ord long, tokens array<string>"))
    classes = N._classes(keyed).localCheckpoint()
    frequency = classes.select(F.explode("tokens").alias("token"), F.lit(1).alias("df"))
    keys = N._rarest(classes, N._rarity(frequency), 0.6).withColumn("before", F.when(F.col("cid") % 3 > 0, F.col("cid"))).localCheckpoint()
    held = {r["cid"]: (r["n"], r["before"], list(r["keys"])) for r in keys.collect()}
    expected = set()
    for cid, (n, before, own) in held.items():
        for other, (m, _, theirs) in held.items():
            if (before is None or other < before) and m >= n * 0.6 - 1e-9 and m * 0.6 <= n + 1e-9:
                least = N._least_shared(n, m, 0.6, N.ARRAYS)
                met = sum(key in theirs and bool(N._in_prefix(n, m, at + 1, theirs.index(key) + 1, 0.6, N.ARRAYS)) for at, key in enumerate(own))
                expected |= {(cid, other)} if met >= least else set()
    for members, meetings in ((10_000, 1_000_000), (40, 7)):
        monkeypatch.setattr(N, "HOT_MEMBERS", members)
        monkeypatch.setattr(N, "MEETINGS", meetings)
        found = N._candidates(keys, keys.select("cid", "n", "keys"), 0.6)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        pairs = [tuple(r) for r in found.collect()]
        assert set(pairs) == expected and len(pairs) == len(expected) > 100


def test_colliding_hashes_lose_no_pair(spark):
    """Sets are compared as they are: tokens of equal 32-bit hashes neither make nor break a match."""
    seen, clash = {}, []
    for i, h in enumerate(r[0] for r in spark.range(200_000).select(F.hash(F.concat(F.lit("t"), F.col("id").cast("string")))).collect()):
        if h in seen:
            clash.append((f"t{seen[h]}", f"t{i}"))
        seen[h] = i
    (a, b), rest = clash[0], ["x", "y"]
    rows = [(0, [a, b, *rest]), (1, [a, b, "x", "z"]), (2, [a, *rest, "p"]), (3, [b, "q", "r", "x"])]
    wanted = {i: next((j for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.6), None) for i in range(4)}
    found = {r["ord"]: r["match"] for r in N.first_near_duplicates(spark.createDataFrame(rows, "ord long, tokens array<string>")).collect()}
    assert found == {i: j for i, j in wanted.items() if j is not None}


def test_inventory_counts_numbers_of_any_script(spark, tmp_path):
    import duckdb

    from citelode.plans import datasets as P

    body = "words of a page " * 40
    rows = [(1, "http://a/1", body + "٣٤ days"), (2, "http://a/2", body + "७ days"), (3, "http://b/1", body + "70 days"), (4, "http://b/2", body)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(tuple(row) for row in P.page_inventory(spark, str(tmp_path)).collect())
    assert found == [("a", 2, 1), ("b", 2, 1)]
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == sorted(duckdb.sql(P.ORACLES["page_inventory"]).fetchall())
    duckdb.sql("DROP VIEW pages")
