import json

import pytest

from sparkloom.schemas import SemanticType as T
from sparkloom.sources import readers, sinks


def test_formats_and_delimiters():
    assert [readers.detect_format(n) for n in ("a.CSV", "b.jsonl", "c.pq", "d.xlsx", "e.tsv")] == ["csv", "json", "parquet", "excel", "csv"]
    assert readers.detect_format(None, b' {"a"') == "json" and readers.detect_format(None, b"PAR1..") == "parquet" and readers.detect_format() == "csv"
    assert [readers.sniff_delimiter(t) for t in ("a;b\n1;2", "a\tb\n1\t2", "a,b\n1,2", "abc")] == [";", "\t", ",", ","]


def test_csv_with_uneven_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id, name ,name,note\n1,Ali,x,"a, b"\n2,NA,n/a\n3,z,y,w,extra\n4,"q""q",,ok\n', encoding="utf-8")
    df = readers.extract(spark, str(path))
    assert df.columns == ["id", "name", "name.1", "note"]
    assert sorted(map(tuple, df.collect())) == [("1", "Ali", "x", "a, b"), ("2", None, None, None), ("4", 'q"q', None, "ok")]


def test_csv_encodings(spark, tmp_path):
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes("a;b\ncafé;ü\n".encode(encoding))
        df = readers.read_csv(spark, str(path))
        assert df.columns == ["a", "b"] and tuple(df.first()) == ("café", "ü")


@pytest.mark.parametrize(
    "text",
    [
        '[{"a": 1, "b": {"c": {"d": "x"}}}, {"a": 2, "b": {"c": {"d": "y"}}}]',
        '{"a": 1, "b": {"c": {"d": "x"}}}\n{broken\n{"a": 2, "b": {"c": {"d": "y"}}}\n',
        '{"total": 2, "records": [{"a": 1, "b": {"c": {"d": "x"}}}, {"a": 2, "b": {"c": {"d": "y"}}}]}',
    ],
)
def test_json_shapes(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    df = readers.extract(spark, str(path))
    assert sorted(df.select("a", "`b.c.d`").where("a IS NOT NULL").collect()) == [(1, "x"), (2, "y")]


def test_pretty_object_and_parquet(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=2))
    assert readers.read_json(spark, str(path)).collect() == [(1, [1, 2])]
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    assert readers.extract(spark, str(tmp_path / "x.parquet")).count() == 3


def test_row_ids_are_dense(spark):
    df = readers.with_row_id(spark.range(100).repartition(7).where("id % 3 = 0"))
    assert sorted(r._row_id for r in df.collect()) == list(range(34))


def bulk_of(lines):
    """What a sequential reader makes of the lines."""
    lines, out, i = [x.strip() for x in lines if x.strip()], [], 0
    while i < len(lines):
        try:
            action = json.loads(lines[i])
            kind = list(action)[0]
            meta = action[kind]
            target, doc = meta.get("_index", "generic_dataset").lower(), str(meta.get("_id", i // 2 + 1))
            if kind in ("index", "create") and i + 1 < len(lines):
                out.append((target, doc, json.loads(lines[i + 1])))
                i += 1
        except (ValueError, AttributeError, IndexError, TypeError):
            pass
        i += 1
    return sorted(out, key=str)


def test_bulk_is_the_sequential_reader(spark):
    act = lambda k, **more: json.dumps({k: more})
    lines = [act("index", _index="I", _id="1"), "", '{"a": 1}', act("delete", _id="1"), "junk", " ", act("create", _index="i"), '{"a": 2}', act("index"), "no object"]
    lines += [act("index", _id="x"), act("index", _id="y"), act("create", _id="z"), act("index", _id="w"), act("create"), '{"b": [1]}', act("update", _id="1"), '{"c": 1}', act("index", _id="last")]
    for shift in range(3):
        df = spark.createDataFrame(list(enumerate(lines[shift:])), "line_no long, line string").repartition(5)
        assert sorted(((r._index, r._id, json.loads(r._source)) for r in sinks.parse_bulk(df).collect()), key=str) == bulk_of(lines[shift:])


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "_id string, _source string") for x in ([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d")]))
    assert sorted(map(tuple, sinks.upsert(old, new).collect())) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_index_tables(spark):
    index = sinks.Index(spark, "Test Index")
    index.delete()
    assert not index.exists()
    df = spark.createDataFrame([(0, "a", None), (1, "b", 5)], "_row_id long, name string, n int")
    done = index.load(df, {"name": T.CITY, "n": T.AGE}, "_row_id")
    assert (done.indexed, done.failed) == (2, 0) and "2 of 2" in done.message and done.mapping == index.mapping()
    assert index.mapping()["mappings"]["properties"]["n"] == {"type": "long"}
    assert index.load(df.where("n = 5").withColumn("name", df.n.cast("string")), {"name": T.CITY}, "_row_id", overwrite=False).indexed == 1
    assert {(r._id, json.loads(r._source)["name"]) for r in spark.table(index.name).collect()} == {("1", "a"), ("2", "5")}
    assert sinks.indices(spark).where(f"index = '{index.name}'").first().docs == 2
    index.delete()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "x int, y string")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert readers.read_csv(spark, str(tmp_path / "c")).collect() == [("1", "a,b")]
    assert spark.read.json(str(tmp_path / "j")).collect() == [(1, "a,b")]


def test_long_first_records_and_late_characters(spark, tmp_path):
    path = tmp_path / "long.json"
    path.write_text("\n".join(json.dumps({"a": i, "text": "x" * (70_000 if i == 0 else 3)}) for i in range(5)))
    assert sorted(r.a for r in readers.read_json(spark, str(path)).collect()) == list(range(5))
    path.write_text("{broken\n" + "\n".join(json.dumps({"a": i}) for i in range(5)))
    assert sorted(r.a for r in readers.read_json(spark, str(path)).where("a IS NOT NULL").collect()) == list(range(5))
    path.write_text('{"records": [\n{"a": 1},\n{"a": 2}\n]}')
    assert sorted(r.a for r in readers.read_json(spark, str(path)).collect()) == [1, 2]
    path = tmp_path / "late.csv"
    path.write_bytes(("a;b\n" + "plain;text\n" * 8_000 + "café;ü\n").encode("latin-1"))
    df = readers.read_csv(spark, str(path))
    assert df.count() == 8_001 and tuple(df.where("a <> 'plain'").first()) == ("café", "ü")
    path.write_text(";".join(f"column_{i:0200d}" for i in range(400)) + "\n" + ";".join("1" * 400) + "\n")
    assert len(readers.read_csv(spark, str(path)).columns) == 400


def test_meta_rows_and_memory(spark, tmp_path):
    path = readers.stored(spark, b"a;b\n1;2\n3;4\n5;6\n", "x.csv")
    df, meta = readers.extract_with_meta(spark, path)
    assert meta == {"format": "csv", "delimiter": ";", "encoding": "UTF-8", "row_count": 3, "col_count": 2}
    assert readers.extract(spark, path, nrows=2).count() == 2 and readers.extract(spark, path, "tsv", delimiter=";").columns == ["a", "b"]
    _, meta = readers.extract_with_meta(spark, readers.stored(spark, '{"a": {"b": 1}}\n{"a": {"b": 2}}\n', "y.json"), flat=False)
    assert meta == {"format": "jsonl", "flattened": False, "row_count": 2, "col_count": 1}
    spark.range(9).write.parquet(str(tmp_path / "z.parquet"))
    assert readers.extract(spark, str(tmp_path / "z.parquet"), nrows=4).count() == 4


def test_json_array(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "IF(id % 2 = 0, NULL, 'x') AS t").repartition(4)
    for rows in (df, df.limit(0)):
        sinks.write_json(rows, str(tmp_path / "a"), array=True)
        text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
        assert sorted(json.loads(text), key=str) == sorted((r.asDict() for r in rows.collect()), key=str)


def test_tables_on_the_way_are_deleted(spark):
    from pathlib import Path

    from sparkloom.sources import scratch

    def folders():
        return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("cut-*")}

    before = folders()
    kept = scratch.cut(spark.range(5))

    def make():
        one = scratch.cut(kept.where("id > 1"))
        return scratch.cut(one.where("id > 2"))

    out = scratch.settled(make)
    assert sorted(r.id for r in out.collect()) == [3, 4] and len(folders() - before) == 2
    at = scratch.mark()
    scratch.cut(out)
    scratch.discard_since(spark, at)
    scratch.discard(kept, out, spark.range(1))
    assert folders() == before


def test_threads_delete_their_own_tables_only(spark):
    import threading

    from sparkloom.sources import scratch

    first, second, found = threading.Event(), threading.Event(), {}

    def one():
        at = scratch.mark()
        scratch.cut(spark.range(3))
        first.set()
        second.wait(60)
        scratch.discard_since(spark, at)

    def two():
        first.wait(60)
        found["table"] = scratch.cut(spark.range(4))
        second.set()

    threads = [threading.Thread(target=f) for f in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found["table"].count() == 4
    scratch.discard(found["table"])
