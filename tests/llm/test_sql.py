import os

import duckdb
import pytest

from shelfspark.llm.queries import QUERIES, SQL

from .data import SF


def rows(found):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in found), key=str)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_all_are_there():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
