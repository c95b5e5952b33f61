import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from citelode.operators import order_stats as S
from citelode.operators import scan


def hot_rows(spark):
    """A third of the rows share one group."""
    rng = random.Random(3)
    rows = [(("hot" if i % 3 == 0 else f"g{rng.randint(0, 9)}"), i, rng.randint(1, 9), rng.random() < 0.2) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, i long, v int, mark boolean")


def test_blocked_scans_equal_plain_windows(spark):
    frame = hot_rows(spark).withColumn("b", scan.integer_block(F.col("i"), 64))
    w = Window.partitionBy("g").orderBy("i")
    value = F.when(F.col("mark"), F.col("i"))
    plain = frame.select(
        "i", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w).alias("s"),
        F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
    )
    blocked = scan.blocked_row_number(frame, ["g"], "b", [F.col("i")], "n")
    blocked = scan.blocked_running_sum(blocked, ["g"], "b", [F.col("i")], "v", "s")
    blocked = scan.blocked_last_value(blocked, ["g"], "b", [F.col("i")], value, "l").select("i", "n", "s", "l")
    assert blocked.exceptAll(plain).count() == 0 and blocked.count() == 3000


def test_last_value_reads_its_rows_twice_and_sorts_them_once(spark):
    frame = spark.range(1000).select((F.col("id") % 7).alias("g"), "id", scan.integer_block(F.col("id"), 64).alias("b"))
    value = F.when(F.col("id") % 200 == 3, F.col("id"))  # most blocks have none
    found = scan.blocked_last_value(frame, ["g"], "b", [F.col("id")], value, "last")
    with_last = found.collect()
    before = lambda r: max((x for x in range(3, r["id"], 200) if x % 7 == r["g"]), default=None)
    assert len(with_last) == 1000 and all(r["last"] == before(r) for r in with_last)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2


def test_order_statistics(spark):
    frame = hot_rows(spark)
    found = S.order_statistics(
        frame, ["g"], "i",
        {"p50": S.nearest_rank(50), "p95": S.nearest_rank(95), "f": S.floor_rank(0.95), "a": S.lower_middle, "b": S.upper_middle},
    )
    values = {}
    for r in frame.collect():
        values.setdefault(r["g"], []).append(r["i"])
    for r in found.collect():
        v = sorted(values[r["g"]])
        n = len(v)
        assert (r["p50"], r["p95"], r["f"]) == (v[round(0.5 * (n - 1))], v[round(0.95 * (n - 1))], v[int(n * 0.95)])
        assert (r["a"], r["b"]) == (v[(n - 1) // 2], v[n // 2])
    assert found.count() == len(values)


def test_nearest_rank_rounds_half_to_even(spark):
    frame = spark.range(48).withColumn("g", F.lit(1))
    r = S.order_statistics(frame, ["g"], "id", {"p50": S.nearest_rank(50), "p95": S.nearest_rank(95)}).first()
    assert (r["p50"], r["p95"]) == (24, 45)


def test_covering_rank_counts_uncovered_groups(spark):
    frame = spark.createDataFrame([(1, 3), (1, 7), (1, None), (1, None)], "g int, v int").withColumn("n", F.lit(4))
    r = S.order_statistics(frame, ["g"], "v", {"p50": S.covering_rank(0.5), "p80": S.covering_rank(0.8)}, of="n").first()
    assert (r["p50"], r["p80"]) == (7, None)


def test_salted_lookup_join(spark):
    from citelode.operators.sizing import lookup_join

    facts = hot_rows(spark)
    lookup = facts.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    salted = lookup_join(facts, lookup, ["g"], rows=2, salts=4)
    assert salted.exceptAll(lookup_join(facts, lookup, ["g"])).count() == 0 and salted.count() == 3000
