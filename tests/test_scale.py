"""What keeps queries in proportion to their input: how rows are dealt, and what is done once."""

import ast

from quarrylight.functions import code
from quarrylight.operators import text as tx
from quarrylight.plans import more_queries


def test_a_file_is_parsed_once(monkeypatch):
    parse, seen = ast.parse, []
    monkeypatch.setattr(ast, "parse", lambda text: seen.append(text) or parse(text))
    code.measure("def f():\n    pass\n", "Python")
    assert len(seen) == 1


def test_metrics_of_repeated_texts(spark):
    """Texts that occur again, in another language or null, get what each of them would get alone."""
    rows = [(t, lang) for t in ("def f(a):\n    if a:\n        pass\n", "func Run(a int) {\n}\n", "def (", "", None) for lang in ("Python", "Go", None)] * 3
    got = code.with_metrics(spark.createDataFrame(rows, "text string, language string").coalesce(1)).collect()
    assert [(r.text, r.language) for r in got] == rows
    assert [r.metrics.asDict(recursive=True) for r in got] == [code.measure(t or "", lang) for t, lang in rows]


def test_python_sources_are_dealt_over_tasks(spark):
    assert more_queries._code_files(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 1


def test_go_sources_are_dealt_over_tasks(spark):
    assert more_queries.c2_c5_c7_c8_brace_metrics(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 1


def test_lines_are_masked_once(spark):
    """No filter over the masked lines stands below their generator, where it would mask the texts again."""
    files = spark.createDataFrame([("a", "x" * 20)], "rel string, text string")
    for df in (tx.significant_lines(files), tx.windows(files, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not [line for line in plan if "Filter" in line and "regexp_replace" in line]
