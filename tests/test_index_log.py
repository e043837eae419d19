import pytest
from pyspark.sql import functions as F

from sparkloom.schemas import SemanticType as T
from sparkloom.sources import sinks


@pytest.fixture
def index(spark):
    made = sinks.Index(spark, "Log Test")
    made.delete()
    yield made
    made.delete()


def source(index):
    rows = index.spark.table(index.name).select("_id", F.get_json_object("_source", "$.x").alias("x")).collect()
    assert len({r._id for r in rows}) == len(rows)
    return {r._id: r.x for r in rows}


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "_row_id long, x string")


def test_loads_write_their_own_documents_only(spark, index, monkeypatch):
    monkeypatch.setattr(sinks.Index, "MOST_TABLES", 3)
    expected = {}
    for k in range(6):
        pairs = [(i, f"{k}.{i}") for i in range(k, 40, k + 1)]
        done = index.load(rows(spark, pairs), {"x": T.CATEGORICAL}, "_row_id", overwrite=False)
        assert (done.indexed, done.failed) == (len(pairs), 0)
        expected |= {str(i + 1): x for i, x in pairs}
        assert source(index) == expected
        log = index.log()
        assert len(log) <= 3 and (len(log) == 1 or spark.table(log[-1]).count() == len(pairs))
    assert index.count() == len(expected) and index.mapping()["mappings"]["properties"]["x"]["type"] == "keyword"


def test_readers_that_began_before_keep_their_tables(spark, index):
    index.load(rows(spark, [(0, "a"), (1, "b")]), {"x": T.CATEGORICAL}, "_row_id")
    before = index.spark.table(index.name)
    index.load(rows(spark, [(1, "c")]), {"x": T.CATEGORICAL}, "_row_id")
    assert before.count() == 2 and source(index) == {"2": "c"}
    index.load(rows(spark, []), {"x": T.CATEGORICAL}, "_row_id", overwrite=False)
    assert source(index) == {"2": "c"} and len(index._tables()) == 2


def test_one_evaluation_and_rows_without_id(spark, index):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = rows(spark, [(0, "a"), (None, "b"), (2, None)]).mapInArrow(count, "_row_id long, x string")
    done = index.load(df, {"x": T.CATEGORICAL}, "_row_id")
    assert (done.indexed, done.failed, seen.value) == (2, 1, 3) and source(index) == {"1": "a", "3": None}


def test_no_shuffle_where_buckets_meet(spark, index):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(3):
            index.load(rows(spark, [(i, "x") for i in range(k, 500)]), {"x": T.CATEGORICAL}, "_row_id", overwrite=False)
        assert "Exchange" not in spark.table(index.name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
