"""Phrases, conversation repair and nearest neighbours: edges, brute force, and the methods."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citelode.llm import neighbours, phrases, turns
from citelode.llm.queries import QUERIES

EXTRA = "part int, size string, count long, mark string, kept boolean"
PAD = (1, "s", 2, "m", True)


# Phrases ------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, first):
    known, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    key = (lang, *words[at:at + size])
                    known[key] = known.get(key, 0) + 1
    candidates = {key: f for key, f in known.items() if len(key) > 2 and f >= least}
    found = []
    for key, a in candidates.items():
        around = [f for other, f in candidates.items() if other[0] == key[0] and len(other) > len(key)
                  and any(other[i:i + len(key) - 1] == key[1:] for i in range(1, len(other)))]
        if any(100 * f >= 100 * a for f in around):
            continue
        cuts = []
        for k in range(1, len(key) - 1):
            left, right = known[key[:k + 1]], known[(key[0], *key[k + 1:])]
            cuts.append((1000 * a * totals[key[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((key[0], " ".join(key[1:]), a, left, right, totals[key[0]], score))
    ranked = []
    for lang in totals:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:first]
        ranked += [(x[0], rank, *x[1:]) for rank, x in enumerate(own, 1)]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "und", "é", "x y", "zu", "a", "b", "c"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(
        rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", "\t", "\x0b"]) for _ in range(rng.randrange(0, 60))
    )) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", " \t . ,"), ("en", "once upon a time " * 40), ("en", "once upon a time " * 40), ("de", "a b c d e f " * 3_000)]
    return rows


@pytest.mark.parametrize("least, first", [(3, 2_000), (8, 5)])
def test_phrases_against_counting(spark, monkeypatch, least, first):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 4_000)  # many ranges
    rows = phrase_rows()
    docs = spark.createDataFrame([(*row, *PAD) for row in rows], f"lang string, text string, {EXTRA}").repartition(5)
    found = sorted(tuple(row) for row in phrases.collocations(docs, least, first).collect())
    assert found == plain_phrases(rows, least, first)
    assert found


def test_phrase_ranges_have_a_task_each(spark):
    cuts = phrases.Ranges(tuple(("en", f"w{i}", "a") for i in range(1, 9)) + (("fr", "w4", "a"),))
    docs = spark.createDataFrame([(lang, " ".join(f"w{i}" for i in range(9))) for lang in ("en", "fr", "it")], "lang string, text string")
    found = phrases.frequent(docs, 1, 1, cuts)
    rows = found.filter("size = 1").select("lang", "phrase", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 27
    assert all(row["task"] == cuts.of(row["lang"], [row["phrase"]]) for row in rows)  # no task holds two ranges
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_phrase_sequences_are_numbers_of_32_bits():
    names, rows, counts, _ = phrases.count_words(pa.array(["a b c d e"] * 3, pa.large_string()), "en", 3, *[phrases.Filter(np.array([2**64 - 1], dtype=np.uint64))] * 2)
    automaton = phrases.Automaton.of_sorted(names, rows[np.lexsort(rows.T[::-1])], counts)
    assert {rows.dtype, automaton.sequences()[0].dtype, *(level.dtype for level in (*automaton.sources, *automaton.labels))} == {np.dtype(np.int32)}


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    blank = spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")
    assert phrases.collocations(blank, 1).collect() == []


def test_automaton_round_trip_and_union():
    rng = random.Random(3)
    shards = []
    for _ in range(4):
        counts = Counter(tuple(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(200))
        words = sorted(set("abcd"))
        rows = np.full((len(counts), 4), -1)
        for at, key in enumerate(sorted(counts)):
            rows[at, :len(key)] = [words.index(w) for w in key]
        shards.append((counts, phrases.Automaton.of_sorted(words, rows, np.array([counts[k] for k in sorted(counts)]))))
    for counts, automaton in shards:
        keys = [list(k) for k in counts]
        assert automaton.lookup(keys) == list(counts.values())
        assert automaton.lookup([["a", "z"], ["a"] * 9]) == [0, 0]
        assert sum(len(level) for level in automaton.labels) <= sum(map(len, counts))
    total = sum((counts for counts, _ in shards), Counter())
    united = phrases.union([automaton for _, automaton in shards])
    assert united.lookup([list(k) for k in total]) == list(total.values())
    rows, counts = united.sequences()
    assert {tuple(united.words[i] for i in row if i >= 0): c for row, c in zip(rows.tolist(), counts.tolist())} == dict(total)


def test_ranges_agree_between_shards():
    cuts = phrases.Ranges((("de", "b", "a"), ("en", "a", "c"), ("en", "a", "m"), ("en", "q", "a")))
    for words in (["a", "b", "m", "q"], ["a", "b", "c", "d", "q", "z"], ["", "a", "a b", "c", "r"]):
        rows = np.array([[i, j] for i in range(len(words)) for j in range(-1, len(words))])
        for lang in ("de", "en", "fr", ""):
            parts = cuts.parts(lang, words, rows)
            assert parts.tolist() == [cuts.of(lang, [words[i] for i in row if i >= 0]) for row in rows.tolist()]


# Conversations ------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    return out


def plain_repair(rows):
    """All edits tried, position by position, with whole audits as ties; insertions included."""
    seen, faults, counts = set(), [], Counter()
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        faults.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    new = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def better(best, state, entry):
        if state not in best or entry[:2] < best[state][:2]:
            best[state] = entry

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                better(best, new[state][1], (cost + 5, audit + "I", [*lines, new[state][0] + ":"]))
        return best

    best = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (state, role[:1]) in keep:
                better(after, keep[state, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            better(after, new[state][1], (cost + more + 1, audit + "R", [*lines, f"{new[state][0]}:{text}"]))
        best = inserted(after)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    numbers = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def repaired(found):
    rows = [tuple(row) for row in found.collect()]
    assert len({row[0] for row in rows}) == len(rows)
    return {row[0]: row[1:] for row in rows}


def expected(rows):
    return {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(QUERIES["op12_turns"](spark, sf_dir)) == expected(rows)


def test_repair_of_edges_and_a_hot_conversation(spark):
    rng = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["a.", "b", "c!", "", " \n", None, "d?", "e. ", *[f"t{i}." for i in range(40)], *[f"u{i}" for i in range(10)]]
    rows = [(rng.choice([1, 2, 3, None]) if rng.random() < 0.4 else 7, rng.choice([None, *range(200)]), rng.choice(roles), rng.choice(texts))
            for _ in range(700)]
    rows += [(50 + i, 0, "user", "only.") for i in range(40)]  # some lose all their turns
    rows += [(7, 3, "user", "again.")] * 30 + [(99, None, None, None)] * 3 + [(100, 5, "user", "x " * 200_000 + ".")]
    table = spark.createDataFrame([(*row, *PAD) for row in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversation 7 spans partitions
    try:
        assert repaired(turns.repair(turns.damage(table), table)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = table.limit(0)
    assert turns.repair(turns.damage(empty), empty).collect() == []


def test_blocks_agree_with_single_turns():
    table = turns.tables(turns.Costs(rerole=3, delete=7, insert=1, truncated=2))  # here insertions pay
    rng = np.random.default_rng(4)
    for size in range(40):
        symbols = rng.integers(0, turns.SYMBOLS, size)
        vector, cost = table.vectors[table.end], 0
        for symbol in symbols[::-1].tolist():
            vector = table._before(vector, symbol)
        left, cost, _ = table.backward(symbols, table.end)
        assert tuple(x + cost for x in table.vectors[left]) == vector
        letters, total, state = table.audit(symbols, table.end, 0, True)
        assert total == vector[0] and state in turns.ACCEPTING
        assert len(letters.replace("I", "")) == size


# Neighbours ---------------------------------------------------------------------------------------------


def plain_nearest(rows, query, k):
    own, vector = query
    found = [(math.dist(vector, other), other_id) for other_id, other in rows if other_id != own and len(other) == len(vector)]
    return sorted(set(found))[:k]


def usable(rows):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return sorted({(i, tuple(v)) for i, v in good})


def test_neighbours_of_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]  # one very common vector
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 3.0]), (2002, [0.0, -1.0])]  # another length, fewer than k
    rows += [(3000, None), (3100, []), (3200, [0.0] * 6), (3300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3400, [float("nan")] * 6),
             (3500, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[0], rows[0], (100, [9.0] * 6)]  # repeated row, and an id with two vectors
    table = spark.createDataFrame([(*row, *PAD) for row in rows], f"vec_id long, embedding array<double>, {EXTRA}").repartition(4)
    found = neighbours.search(table, F.col("id") % 100 == 0, k=5).collect()
    good = usable(rows)
    got = {}
    for row in found:
        got.setdefault(row["query_id"], []).append((row["rank"], row["score"], row["id"]))
    queries = [(i, v) for i, v in good if i % 100 == 0]
    assert set(got) == {i for i, _ in queries}
    hits = wanted = 0
    for own, vector in queries:
        near = plain_nearest(good, (own, vector), 5)
        own_rows = sorted(got[own])
        if own != 100:
            assert [rank for rank, _, _ in own_rows] == list(range(1, len(near) + 1))
        known = {(other, round(math.dist(vector, v), 9)) for other, v in good if len(v) == len(vector)}
        if own != 100:
            assert all((other, round(score, 9)) in known for _, score, other in own_rows)
        hits += len({other for _, other in near} & {other for _, _, other in own_rows})
        wanted += len(near)
    assert hits / wanted >= 0.9
    same = [other for _, score, other in sorted(got[1100]) if score == 0.0]
    assert same == [1000, 1001, 1002, 1003, 1004]  # ties by id, its own id left out
    assert neighbours.search(table.limit(0), F.col("id") % 100 == 0).collect() == []
    assert neighbours.search(table.filter("vec_id = 7"), F.col("id") == 7).collect() == []


def test_neighbour_recall_and_scores(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    good = usable(rows)
    vectors = dict(good)
    got = {}
    for row in QUERIES["op13_neighbours"](spark, folder).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    hits = 0
    for own in got:
        near = plain_nearest(good, (own, vectors[own]), 10)
        listed = sorted(got[own])
        assert [rank for rank, _, _ in listed] == list(range(1, 11))
        assert all(abs(score - math.dist(vectors[own], vectors[other])) < 1e-12 for _, other, score in listed)
        assert [(score, other) for _, other, score in listed] == sorted((score, other) for _, other, score in listed)
        hits += len({other for _, other in near} & {other for _, other, _ in listed})
    assert set(got) == {i for i, _ in good if i % 100 == 0}
    assert hits / (10 * len(got)) >= 0.9


def test_forest_order_is_by_bound():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(2_000, 8))
    forest = neighbours.Forest.fit(sample, trees=3)
    leaves = forest.leaves(sample)
    query = rng.normal(size=8)
    order = list(forest.opened(query))
    assert len(order) == len(set(order)) == 3 << forest.depth
    assert {(t, int(leaf)) for t, leaf in enumerate(forest.leaves(query[None])[0])} == set(order[:3])
    for tree in range(3):
        counts = np.bincount(leaves[:, tree], minlength=1 << forest.depth)
        assert counts.max() <= 3 * neighbours.LEAF_ROWS
