"""Queries for manifests, code metrics and small reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import with_metrics
from ..functions.scalars import grade
from ..operators import findings as fi
from ..operators import text as tx
from ..sources.manifests import manifests
from ..tables import table
from ..operators import history as hi
from . import metrics as mt
from .history_queries import CARD, FINDINGS, GRADE, _scores, findings
from .mapping import changes, commits, documents, file_stats, spread
from .registry import query
from .text_queries import CLONES
from .tree_queries import _sql_pick


@query(f"WITH {CLONES} SELECT * FROM found ORDER BY lines DESC, first_file, first_line, second_file, second_line LIMIT 40")
def t3_largest_clones(spark: SparkSession, d: str) -> DataFrame:
    found = tx.clones(documents(spark, d), least=4)
    return found.orderBy(F.desc("lines"), "first_file", "first_line", "second_file", "second_line").limit(40)


@query(f"WITH {FINDINGS} SELECT rule, array_to_string(list_slice(list(file || ':' || line ORDER BY line), 1, 10), ' ') AS evidence, count(*) AS n FROM w GROUP BY rule")
def t8_t9_evidence_caps(spark: SparkSession, d: str) -> DataFrame:
    """The first ten places of each rule; capped before gathering, so that no group is collected whole."""
    from pyspark.sql import Window

    f = findings(spark, d)
    first = f.withColumn("rn", F.row_number().over(Window.partitionBy("rule").orderBy("line"))).filter("rn <= 10")
    places = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("line", "file"))).alias("p"))
    shown = places.select("rule", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))), " ").alias("evidence"))
    return shown.join(f.groupBy("rule").agg(F.count("*").alias("n")), "rule")


@query(f"WITH {FINDINGS}, {CARD} SELECT dimension, {GRADE.format('score')} AS grade, coalesce(score < 70, false) AS fails FROM scores")
def g5_grade_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each dimension falls below grade C; what was not measured passes."""
    return _scores(spark, d).select("dimension", grade(F.col("score")).alias("grade"), F.coalesce(F.col("score") < 70, F.lit(False)).alias("fails"))


@query(f"WITH {FINDINGS} SELECT dimension, '{{\"dimension\":\"' || dimension || '\",\"n\":' || count(*) || '}}' AS document FROM w GROUP BY dimension")
def k1_json_rows(spark: SparkSession, d: str) -> DataFrame:
    one = findings(spark, d).groupBy("dimension").agg(F.count("*").alias("n"))
    return one.select("dimension", F.to_json(F.struct("dimension", "n")).alias("document"))


@query(f"WITH {FINDINGS} SELECT dimension, severity, count(*) AS n, CAST(sum(penalty) AS DOUBLE) AS points FROM w GROUP BY ROLLUP (dimension, severity) HAVING dimension IS NOT NULL")
def a22_dimension_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = fi.weighed(findings(spark, d)).rollup("dimension", "severity").agg(F.count("*").alias("n"), F.sum("penalty").cast("double").alias("points"))
    return rows.filter("dimension is not null")


_PACKAGES = ["requests", "flask", "numpy", "pytest", "click"]


def _requirement_files(spark: SparkSession, d: str) -> DataFrame:
    """files(rel, text): a requirements file for each supplier, one line for each of five packages, comments between."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    body = [F.concat(F.lit(f"{p}=={i}."), k) if i % 2 else F.concat(F.lit(f"{p}[extra]>={i}."), k, F.lit("  # note")) for i, p in enumerate(_PACKAGES)]
    text = F.concat_ws("\n", F.lit("# generated"), F.lit("-r base.txt"), *body, F.lit("https://example.org/x.whl"))
    return s.select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "a/requirements-dev").otherwise("a/requirements-latest"), F.lit("-"), k, F.lit(".txt")).alias("rel"), text.alias("text"))


@query(
    f"""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'a/requirements-dev' ELSE 'a/requirements-latest' END || '-' || s_suppkey || '.txt' AS manifest, CASE WHEN s_suppkey % 3 = 0 THEN 'dev' ELSE 'prod' END AS grp,
    {_sql_pick(_PACKAGES, 'i')} AS name, CASE WHEN i % 2 = 1 THEN '==' ELSE '>=' END || i || '.' || s_suppkey AS spec, CAST(i + 3 AS INTEGER) AS line FROM supplier, range(5) AS r(i)"""
)
def m4_m5_requirements(spark: SparkSession, d: str) -> DataFrame:
    found = manifests(_requirement_files(spark, d))
    return found.select("manifest", F.explode("deps").alias("x")).select("manifest", "x.grp", "x.name", "x.spec", "x.line")


@query(
    """SELECT 'p' || s_suppkey || '/package.json' AS manifest, unnest(['prod', 'prod', 'dev', 'peer']) AS grp, unnest(['left-pad', 'lodash', 'jest', 'react']) AS name,
    unnest(['^1.0.' || s_suppkey, '4.17.21', '~29.' || s_suppkey, '>=' || s_suppkey]) AS spec FROM supplier"""
)
def m1_m14_package_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('{"dependencies": {"left-pad": "^1.0.'), k, F.lit('", "lodash": "4.17.21", "odd": {"x": 1}}, "devDependencies": {"jest": "~29.'), k, F.lit('"}, "peerDependencies": {"react": ">='), k, F.lit('"}}')
    )
    files = table(spark, d, "supplier").select(F.concat(F.lit("p"), k, F.lit("/package.json")).alias("rel"), text.alias("text"))
    return manifests(files).select("manifest", F.explode("deps").alias("x")).select("manifest", "x.grp", "x.name", "x.spec")


def _code_files(spark: SparkSession, d: str) -> DataFrame:
    """files(rel, text, language): Python functions with as many branches as the part's size."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    branches = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("    if x > "), i.cast("string"), F.lit(":\n        x += 1\n"))), "")
    return p.select(F.col("p_partkey").alias("rel"), F.concat(F.lit("def f(x, *a):\n"), branches, F.lit("    return x\n\n\ndef test_nothing():\n    pass\n")).alias("text"), F.lit("Python").alias("language"))


@query("SELECT p_partkey AS rel, CAST(p_size + 1 AS INTEGER) AS complexity, CAST(2 * p_size + 2 AS INTEGER) AS length, CAST(2 AS INTEGER) AS args, CAST(1 AS INTEGER) AS max_depth, CAST(1 AS INTEGER) AS empty_tests FROM part")
def c3_c4_c14_python_metrics(spark: SparkSession, d: str) -> DataFrame:
    m, first = with_metrics(_code_files(spark, d)), F.get("metrics.functions", F.lit(0))
    return m.select("rel", first["complexity"].alias("complexity"), first["length"].alias("length"), first["args"].alias("args"), F.col("metrics.max_depth").alias("max_depth"), F.size("metrics.empty_tests").alias("empty_tests"))


@query("SELECT p_partkey AS rel, CAST(p_size + 2 AS INTEGER) AS length, CAST(2 AS INTEGER) AS args, CAST(1 AS INTEGER) AS functions FROM part")
def c2_c5_c7_c8_brace_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Go functions found by declarations and braces, comments stripped."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.lit('  x := "}" // }\n')), "")
    files = p.select(F.col("p_partkey").alias("rel"), F.concat(F.lit("/* { */\nfunc Run(a int, b string) {\n"), body, F.lit("}\n")).alias("text"), F.lit("Go").alias("language"))
    m, first = with_metrics(files), F.get("metrics.functions", F.lit(0))
    return m.select("rel", first["length"].alias("length"), first["args"].alias("args"), F.size("metrics.functions").alias("functions"))


@query(
    """WITH h AS (SELECT path, count(*) AS n, sum(added + deleted) AS churn FROM changes JOIN commits USING (sha) GROUP BY path)
    SELECT (SELECT count(*) FROM commits) AS commits_in_window, (SELECT count(DISTINCT author) FROM commits) AS contributors_in_window, (SELECT count(*) FROM h) AS files_changed,
    (SELECT CAST(sum(churn) AS BIGINT) FROM h JOIN file_stats ON rel = path WHERE n >= 3 AND NOT is_test AND total_lines > 0) AS churn_total"""
)
def m_hotspot_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a report says of the history as a whole."""
    log = commits(spark, d)
    return mt.hotspots(hi.file_history(log, changes(spark, d)), log, file_stats(spark, d), 3)


@query(f"WITH {FINDINGS} SELECT rule, count(*) - 12 AS dropped FROM w GROUP BY rule HAVING count(*) > 12")
def m_capped_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many findings of each rule a report leaves out."""
    return mt.capped_rules(findings(spark, d), 12)


@query("SELECT rel AS file, CAST(size AS BIGINT) AS bytes FROM files WHERE size > 8000 ORDER BY size DESC, rel LIMIT 20")
def m_large_files(spark: SparkSession, d: str) -> DataFrame:
    return mt.large_files(documents(spark, d), 8000).select("file", "bytes")


@query("SELECT branch, age_days FROM (SELECT sha AS branch, (996710400 - ts) / 86400.0::DOUBLE AS age_days, ts FROM commits WHERE NOT is_merge AND ts <= 996710400 - 90 * 86400) ORDER BY ts DESC, branch LIMIT 20")
def m_long_lived_branches(spark: SparkSession, d: str) -> DataFrame:
    refs = commits(spark, d).select(F.col("sha").alias("branch"), "ts", F.col("is_merge").alias("is_current"))
    return hi.stale_branches(refs, 996_710_400, 90, 20).select("branch", "age_days")
