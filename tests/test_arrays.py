"""JSON arrays read in splits, against json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citelode.sources import arrays, records

HOSTILE = ['}', '{', ']', '[', '"', '\\', '},{', '"}, {"', '\\"}', "é{", "\n", "\\\\", ': [ {']


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice([*HOSTILE, "ab", " ", "x"]) for _ in range(rng.randrange(5)))
    if kind == 2:
        return rng.choice([None, True, -1.5, 7])
    if kind == 3:
        return rng.randrange(10)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{rng.choice(HOSTILE)}{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def items(n, seed):
    rng = random.Random(seed)
    return [{"id": f"i{i}", "question": value(rng), "more": value(rng)} for i in range(n)]


def dump(kind, rows):
    indent = 2 if kind.endswith("pretty") else None
    if kind.startswith("bare"):
        return json.dumps(rows, indent=indent, ensure_ascii=False)
    around = {"version": {"a": {"b": 1}, "c": {}}, "other": [{"id": "no"}, {"id": "neither"}], "questions": rows, "last": [{"id": "no more"}, 5], "end": {"id": {"x": {}}}}
    return json.dumps(around, indent=indent, ensure_ascii=False)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, setting in old.items():
        spark.conf.set(key, setting)


@pytest.mark.parametrize("kind", ["bare", "bare pretty", "wrapped", "wrapped pretty"])
def test_elements_of_a_file_over_many_splits(spark, tmp_path, small_splits, kind):
    rows = items(150, kind)
    path = tmp_path / "items.json"
    path.write_text(dump(kind, rows), encoding="utf-8")
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 3
    found = arrays.array_elements(spark, str(path)).orderBy("element").collect()
    assert [json.loads(row["json"]) for row in found] == rows


def test_several_files_and_edges(spark, tmp_path, small_splits):
    texts = {
        "a.json": dump("bare", items(30, 1)), "b.json": dump("wrapped", items(20, 2)), "none.json": "[]", "empty.json": "", "nothing.json": '{"questions": []}',
        "scalars.json": '[1, "x", {"id": "s"}, [2], {"id": "t"}]', "absent.json": '{"answers": [{"id": "z"}]}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = records.read_records(spark, str(tmp_path), "id string")
    want = [f"i{i}" for i in range(30)] + [f"i{i}" for i in range(20)] + ["s", "t"]
    assert sorted(row["id"] for row in got.collect()) == sorted(want)
