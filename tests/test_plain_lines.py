import pytest

import __spark_entry__ as entry

ODD = ["", "\n", "\n\n", " ", "\t", " ", "　# x", "\t# x", "a\r\nb\r\n\r\n# c\r\n", "'''doc''' # x", '"""doc"""\n', '"a # b"\n  # c', None, "x" * 130 + "\n" + "é" * 121, "  #\n#", "\r"]


def equals_sql(spark, tmp_path, name, texts):
    import duckdb

    rows = [(i, t, "en", "odd", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.select(*columns).collect())) == order(want.fetchall())


@pytest.mark.parametrize("name", ["c1_line_stats", "a9_line_totals", "a10_language_totals"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Texts that are empty, null, or hold other spaces, line ends and quotes than usual."""
    equals_sql(spark, tmp_path, name, ODD)


def test_very_long_quoted_line(spark, tmp_path):
    """A long line is counted without a pattern that nests for each of its characters."""
    equals_sql(spark, tmp_path, "rule_long_lines", ["code\n" * 20 + ('"' + "y" * 60_000 + '"\n') * 4, "code\n" * 30])


def test_each_text_is_split_once(spark, tmp_path):
    """The filters read the counts, and do not split every text again for each of them."""
    spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    plan = entry.queries()["rule_long_lines"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    equals_sql(spark, tmp_path / "odd", "rule_long_lines", [*ODD, ("x" * 121 + "\n") * 20, "code\n" * 20 + ("é" * 121 + "\n") * 4, "code\n" * 17 + "y" * 121 + "\n" + "z" * 121 + "\n" + "y" * 121])
