"""Every query of the library against the SQL that tells its result from the columns."""

import duckdb
import pytest

from spoor.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders events pages".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert found == sorted(map(repr, expected))


def test_the_rest_does_not_need_the_operators_of_the_pipeline():
    import pathlib

    import spoor

    top = pathlib.Path(spoor.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "spoor.llm" not in path.read_text(), path
