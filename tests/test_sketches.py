from sparkloom.operators import dedup, profile, sketches
from sparkloom.sources.scratch import cut

ROWS = [(i, f"v{i % 700}" if i % 9 else None, None, "x") for i in range(5000)]
SCHEMA = "id int, `some.name` string, nothing string, one string"


def rows(df):
    return {r.col_name: r.asDict() for r in sketches.estimates(df).collect()}


def same(a, b):
    """All but the estimates, which may differ by a little where sketches were united."""
    assert all(abs(a[c]["unique_estimate"] - b[c]["unique_estimate"]) <= 0.02 * b[c]["unique_estimate"] for c in b)
    assert [{**r, "unique_estimate": 0} for _, r in sorted(a.items())] == [{**r, "unique_estimate": 0} for _, r in sorted(b.items())]


def test_merged_is_the_sketch_of_all(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    parts = [cut(sketches.sketch(df.where(f"id % 3 = {k}"))) for k in range(3)]
    whole, merged = rows(sketches.sketch(df)), rows(sketches.merge(sketches.merge(parts[0], parts[1]), parts[2]))
    same(merged, whole)
    again = rows(sketches.merge(sketches.sketch(df), sketches.sketch(df.limit(0))))
    same(again, whole)
    assert (whole["some.name"]["total_count"], whole["some.name"]["null_count"]) == (5000, len([1 for r in ROWS if r[1] is None]))
    assert abs(whole["id"]["unique_estimate"] / 5000 - 1) < 0.05 and abs(whole["some.name"]["unique_estimate"] / 700 - 1) < 0.05
    assert (whole["nothing"]["low"], whole["nothing"]["sample_values"], whole["nothing"]["unique_estimate"]) == (None, [], 0)
    assert whole["one"]["sample_values"] == ["x"] and len(set(whole["id"]["sample_values"])) == 10


def test_samples_depend_on_seed_and_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one, two, other = (rows(sketches.sketch(d, seed))["some.name"]["sample_values"] for d, seed in ((df, 1), (df.union(df), 1), (df, 2)))
    assert one == two != other
    assert sketches.sketch(df.limit(0)).collect() == []


def test_size_of_a_plan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    assert 0 < profile.size_in_bytes(spark.read.parquet(str(tmp_path / "t"))) < 10_000_000


def test_report_counts_while_it_writes(spark):
    """Rows before and after come from the pass that removes the equal ones: no further job counts them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "abcdefgh"), (5, "abcdefgx")], "i int, x string").mapInArrow(count, "i int, x string")
    got = dedup.dedup_report(df, "i", ["x"]).first().asDict()
    assert got == {"initial_rows": 5, "exact_duplicates_removed": 1, "fuzzy_duplicates_removed": 1, "final_rows": 3}
    assert seen.value == 5


def test_dates_in_any_layout(spark):
    from sparkloom.operators import validate
    from sparkloom.schemas import SemanticType as T

    values = ["5th of March 2021", "5th of March 2021", "June 7 2019, 7 pm", "2024-03-05", "May", "soon", "12.5", None]
    df = spark.createDataFrame([(v,) for v in values], "seen string")
    freq = profile.value_frequencies(df)
    plain, more = ({r.kind: round(r.ratio * 7) for r in profile.kinds(freq, a).collect()} for a in (False, True))
    assert plain["datetime"] == 1 and more["datetime"] == 4 and more["other"] == plain["other"] - 3
    plain, more = (validate.validate(df, {"seen": T.DATETIME}, a).first() for a in (False, True))
    assert (plain.valid_count, more.valid_count, more.valid_count + more.invalid_count, more.null_count) == (1, 4, 7, 1)
    many = spark.createDataFrame([(f"{4 + i % 17}th of March {1950 + i}",) for i in range(60)], "seen string")
    assert (profile.profile(many).first().regex_match_rate, profile.profile(many, any_layout=True).first().regex_match_rate) == (0.0, 1.0)
