import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NATIVE = [n for n in entry.QUERIES if n in entry.ORACLES]


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["path", "commits"]


@pytest.mark.parametrize("name", NATIVE)
def test_query_equals_sql(spark, name):
    import duckdb

    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
