import json
import random

import pytest

from sparkloom.sources import json_ranges, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "151")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records(seed, n=60):
    rng = random.Random(seed)
    odd = ["}", "{", "]", "[", '"', "\\", ",", ":", 'a"}b', "\\}", "é", "\n", "x" * 40, ""]
    return [{"id": i, "note": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "in": {"list": [{"k": rng.choice(odd)}] * rng.randint(0, 2), "n": i}} for i in range(n)]


def rows(spark, path):
    df = readers.read_json(spark, path)
    return sorted((r["id"], r["note"], r["in.n"], tuple(x.k for x in r["in.list"] or [])) for r in df.collect())


def expected(found):
    return sorted((r["id"], r["note"], r["in"]["n"], tuple(x["k"] for x in r["in"]["list"])) for r in found)


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 1), (3, None)])
def test_array_over_many_splits(spark, small_splits, seed, indent):
    found = records(seed)
    path = readers.stored(spark, json.dumps(found, indent=indent, ensure_ascii=bool(indent)), "input.json")
    assert json_ranges.pieces_of(spark, path).rdd.getNumPartitions() > 20
    assert rows(spark, path) == expected(found)


@pytest.mark.parametrize("indent", [None, 2])
def test_wrapped_array_among_others(spark, small_splits, indent):
    found = records(4)
    whole = {"records": 3, "meta": {"items": [{"id": 1}], "x": [[{"id": 2}]]}, "other": [{"id": 5, "in": {}}, [{"id": 6}]], "rows": found, "z": [{"id": 9}], "data": "no list"}
    path = readers.stored(spark, json.dumps(whole, indent=indent), "input.json")
    assert rows(spark, path) == expected(found)


def test_first_wrapper_wins_and_order_is_that_of_the_list(spark):
    path = readers.stored(spark, '{"rows": [{"a": 1}], "data": [{"a": 2}, {"a": 3}, 4, "}"]}', "input.json")
    assert sorted(r.a for r in readers.read_json(spark, path).collect()) == [2, 3]


def test_empty_arrays_and_single_objects(spark):
    for text in ('{"data": []}', "[]", " [ ]\n"):
        assert readers.read_json(spark, readers.stored(spark, text, "input.json")).collect() == []
    df = readers.read_json(spark, readers.stored(spark, '{"a": {"b": 1},\n "c": {"rows": [{"d": 2}]}}', "input.json"))
    assert df.columns == ["a.b", "c.rows"] and df.count() == 1
    assert [r.asDict() for r in readers.read_json(spark, readers.stored(spark, '[{"a": 1}]', "input.json")).collect()] == [{"a": 1}]


def test_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("﻿" + json.dumps([{"id": 10 * k + i} for i in range(k)]), encoding="utf-8")
    assert sorted(r.id for r in readers.read_json(spark, str(tmp_path)).collect()) == [10, 20, 21]
