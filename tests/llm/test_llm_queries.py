import os

import pytest
from sparkloom.llm.queries import ORACLE_SQL, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(tiny):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{tiny}/{file}'")
    df = QUERIES[name](spark, tiny)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
