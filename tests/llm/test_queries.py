import pytest

from checks.compare import connect, rows_of
from veilspan.llm import queries

QUERIES = queries.registry()


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.oracle()))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = connect(sf_dir).execute(queries.oracle()[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, done.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in queries.oracle()])
def test_whole_table(spark, sf_dir, name):
    source = "pages" if name.startswith("op1_") else "documents"
    given = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    found = QUERIES[name](spark, sf_dir)
    key = given.columns[0]
    assert found.select(key).distinct().count() == given.count()
