from sparkloom import pipeline
from sparkloom.schemas import ColumnPlan, Outlier, TablePlan
from sparkloom.schemas import SemanticType as T
from sparkloom.streaming.clean_stream import clean_stream, drop_repeats, fitted_bounds

MEMBERS = """member,phone,contact,age,birth_date,monthly_fee,cnic,joined_at
M7,0345 7654321,ines@post.example,44,1979-11-02,"Rs 3,250",42101-7654321-9,2022-06-05 07:00
M8,+92 312 1112223,omar@post.example,230,1988-12-30,PKR 1800,4210176543219,2022/07/19 18:45:10
M9,3019998887,,52,,"$1,075.50",42103-7654321-7,08-03-2022
M3,00923451010101,lea@post.example,,17/09/1995,"2,000",,2022-09-01T10:30:00
M7,0345 7654321,ines@post.example,44,1979-11-02,"Rs 3,250",42101-7654321-9,2022-06-05 07:00
"""
RIDES = """ride,rider,duration,fare
1,K,2:05:09,PKR 700
2,L,11:20:45 PM,Rs. 95
3,M,1h 12m,40
4,N,0:09:30,0
"""


def test_members(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MEMBERS)
    result = pipeline.run(spark, str(tmp_path / "m.csv"), "members_test")
    assert result.success, result.message
    assert (result.rows_in, result.rows_out, result.indexed, result.validation_passed) == (5, 4, 4, True)
    assert result.types["phone"] == T.PHONE_PAKISTAN and result.types["age"] == T.AGE and result.types["cnic"] == T.CNIC_PAKISTAN
    rows = result.cleaned.orderBy("_row_id").collect()
    assert [r.phone for r in rows] == ["923457654321", "923121112223", "923019998887", "923451010101"]
    assert [r.monthly_fee for r in rows] == [3250.0, 1800.0, 1075.5, 2000.0]
    assert [r.age for r in rows] == [44, 230, 52, 48]
    assert [r.cnic for r in rows] == ["42101-7654321-9", "42101-7654321-9", "42103-7654321-7", "Unknown"]


def test_rides(spark, tmp_path):
    (tmp_path / "rides.csv").write_text(RIDES)
    result = pipeline.run(spark, str(tmp_path / "rides.csv"))
    assert result.types["duration"] in (T.DURATION, T.TIME)
    assert [r.duration for r in result.cleaned.orderBy("_row_id").collect()] == ["2:05:09", "23:20:45", "1:12:00", "0:09:30"]


def test_failure_is_told(spark):
    result = pipeline.run(spark, "/nowhere/x.csv")
    assert not result.success and result.stage == "extract" and result.message


def test_stream(spark, tmp_path):
    plan = TablePlan({"phone": ColumnPlan(T.PHONE_PAKISTAN), "x": ColumnPlan(T.NUMERIC_FLOAT, outlier=Outlier.CLIP_IQR)})
    sample = spark.createDataFrame([("1", float(i)) for i in range(20)], "phone string, x double")
    bounds = fitted_bounds(sample, plan)
    spark.createDataFrame([("0300-1234567", 500.0, "2024-01-01 00:00:00"), ("0300-1234567", 500.0, "2024-01-01 00:00:01"), (None, None, "2024-01-01 00:00:02")], "phone string, x double, t string").selectExpr(
        "phone", "x", "CAST(t AS timestamp) AS t"
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("phone string, x double, t timestamp").parquet(str(tmp_path / "in"))
    out = drop_repeats(clean_stream(stream, plan, bounds), ["phone"], "t")
    q = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(((r.phone, r.x) for r in spark.table("cleaned").collect()), key=str)
    assert [p for p, _ in got] == ["923001234567", None]
    assert got[0][1] == bounds["x"][1]
