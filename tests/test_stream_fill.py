from sparkloom.queries import stream_fill_forward
from sparkloom.schemas import ColumnPlan, Impute, TablePlan
from sparkloom.schemas import SemanticType as T
from sparkloom.streaming.clean_stream import fill_forward, fill_stream, fitted_fills


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_values_are_carried_between_batches(spark, tmp_path):
    batches = [[("a", 1, None, "u"), ("a", 2, 5.0, None), ("b", 3, None, None)], [("a", 4, None, None), (None, 5, 7.0, "w"), ("b", 6, 2.0, None)], [(None, 8, None, None), ("b", 7, None, "z"), ("a", 9, None, "q")], []]
    schema = "k string, i int, x double, w string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.i: (r.k, r.x, r.w) for r in run(fill_forward(stream, ["x", "w"], ["k"], "i"), tmp_path, "carried")}
    assert got == {
        1: ("a", None, "u"), 2: ("a", 5.0, "u"), 3: ("b", None, None), 4: ("a", 5.0, "u"), 5: (None, 7.0, "w"), 6: ("b", 2.0, None), 7: ("b", 2.0, "z"), 8: (None, 7.0, "w"), 9: ("a", 5.0, "q"),
    }


def test_fitted_values_and_dropped_rows(spark, tmp_path):
    plan = TablePlan({"age": ColumnPlan(T.AGE), "city": ColumnPlan(T.CITY), "note": ColumnPlan(impute=Impute.CONSTANT), "x": ColumnPlan(T.NUMERIC_FLOAT, impute=Impute.DROP_ROW)})
    schema = "age string, city string, note string, x string"
    sample = spark.createDataFrame([("20", "Rome", "n", "1"), ("40", "Rome", None, "2"), ("30", "Oslo", None, "3")], schema)
    fills = fitted_fills(sample, plan)
    assert fills == {"age": 30, "city": "Rome", "note": "Unknown"}
    spark.createDataFrame([(None, None, None, "1"), ("7", "Bonn", "k", None), ("8", None, "k", "4")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in run(fill_stream(stream, plan, fills), tmp_path, "filled")) == [("30", "Rome", "Unknown", "1"), ("8", "Rome", "k", "4")]


def test_batches_of_several_files_are_filled_by_order(spark, tmp_path):
    """Each file holds events of the whole batch, so a batch that is split by files is filled from later ones."""
    rows = spark.range(400).selectExpr("id AS event_id", "id % 3 AS user_id", "IF(id % 5 = 0, id * 1.0D, NULL) AS value")
    rows.repartition(6, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.value for r in stream_fill_forward(spark, str(tmp_path)).collect()}
    want, last = {}, {}
    for i in range(400):
        if i % 5 == 0 and i % 4:
            last[i % 3] = float(i)
        want[i] = last.get(i % 3)
    assert got == want
