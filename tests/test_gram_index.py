import pytest

from sparkloom.operators import search
from sparkloom.operators.gram_index import NUMBER, GramIndex, grams
from sparkloom.sources.scratch import shared_path

ROWS = [(1, "Annabelle", "green tea"), (2, "Hannah", None), (3, None, None), (4, "", "an"), (5, "ANNA", "anna"), (6, "Ünna ÄNN", "b" * 5000 + "needle"), (6, "Ünna ÄNN", "b" * 5000 + "needle")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS * 3, "id int, name string, `of.note` string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, rows):
    return GramIndex(spark, shared_path(spark, "grams"), 8).build(rows)


@pytest.mark.parametrize("term", ["anna", "ANN", "an", "a", "", "needle", "ünna", "tea", "nothing here", "e", "bbbbneed", "6"])
def test_same_rows_and_scores_as_a_scan(rows, index, term):
    query = {"multi_match": {"query": term}}
    got, expected = (sorted((tuple(r) for r in df.collect()), key=repr) for df in (index.search(query), search.search(rows, query)))
    assert got == expected


def test_only_the_folders_of_the_term_are_read(index):
    plan = index.lists(grams("needle"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan.replace("\n", " ") or "folder" in plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "In(gram" in plan or "gram IN" in plan
    plan = index.search({"multi_match": {"query": "needle"}})._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_empty_table_and_names(spark, rows):
    empty = GramIndex(spark, shared_path(spark, "grams"), 4).build(rows.limit(0))
    assert empty.search({"multi_match": {"query": "anna"}}).collect() == []
    with pytest.raises(ValueError):
        GramIndex(spark, shared_path(spark, "grams")).build(rows.withColumnRenamed("id", NUMBER))
