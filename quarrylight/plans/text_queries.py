"""Queries over the text of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as tx
from ..tables import table
from .mapping import documents, file_stats
from .registry import query

_LINES = """lines AS (
  SELECT rel, text, CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END AS l FROM files
)"""
_STATS = f"""{_LINES}, stats AS (
  SELECT rel, len(l) AS total_lines, len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS code_lines, len(list_filter(l, lambda x: starts_with(trim(x), '#'))) AS comment_lines,
    len(list_filter(l, lambda x: trim(x) = '')) AS blank_lines, len(list_filter(l, lambda x: length(x) > 120)) AS long_lines, coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS max_line_length FROM lines
)"""
_BIG = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("total_lines", "code_lines", "comment_lines", "blank_lines", "long_lines", "max_line_length"))
_NORMAL = (
    r"""regexp_replace(regexp_replace(regexp_replace(trim(x), '\s+', ' ', 'g'), '"[^"]*"|''[^'']*''|`[^`]*`', 'STR', 'g'), '(^|[^0-9A-Za-z_])([0-9]+)($|[^0-9A-Za-z_])', '\1NUM\3', 'g')"""
)


@query(f"WITH {_STATS} SELECT rel, {_BIG} FROM stats")
def c1_line_stats(spark: SparkSession, d: str) -> DataFrame:
    return tx.line_stats(documents(spark, d), comment="#").drop("text", "size", "language")


@query(f"WITH {_STATS} SELECT language, count(*) AS files, CAST(sum(code_lines) AS BIGINT) AS code_lines FROM stats JOIN files USING (rel) GROUP BY language")
def a10_language_totals(spark: SparkSession, d: str) -> DataFrame:
    return tx.language_totals(tx.line_stats(documents(spark, d), comment="#"))


@query(f"WITH {_STATS} SELECT CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines FROM stats")
def a9_line_totals(spark: SparkSession, d: str) -> DataFrame:
    return tx.line_stats(documents(spark, d), comment="#").agg(*[F.sum(c).alias(c) for c in ("total_lines", "code_lines", "blank_lines")])


@query(f"WITH {_STATS} SELECT rel, total_lines::BIGINT AS total_lines FROM stats ORDER BY total_lines DESC, rel LIMIT 10")
def t4_largest_files(spark: SparkSession, d: str) -> DataFrame:
    return tx.line_stats(documents(spark, d), comment="#").orderBy(F.desc("total_lines"), "rel").limit(10).select("rel", "total_lines")


@query("SELECT rel, CAST(size AS BIGINT) AS size FROM files WHERE size > 8000 ORDER BY size DESC, rel LIMIT 20")
def t5_large_blobs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(F.col("size") > 8000).orderBy(F.desc("size"), "rel").limit(20).select("rel", "size")


@query()
def c6_branch_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Branches of every document by the family of each third of them; the engines' word boundaries differ beyond ASCII, so it
    is held against a plain count in the tests."""
    family = F.get(F.array(*[F.lit(x) for x in ("Go", "Ruby", "Python")]), F.pmod(F.crc32(F.col("rel").cast("binary")), F.lit(3)).cast("int"))
    return documents(spark, d).select("rel", family.alias("family"), tx.branch_count(F.col("text"), family).alias("branches"))


@query()
def a17_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Assertions in every document; held against a plain count in the tests, as c6."""
    return documents(spark, d).select("rel", tx.assertions(F.col("text")).alias("assertions"))


_SMELLS = ((r"secret", "secret"), (r"[0-9]{4,}", "long number"), (r"License", "license"), (r"https?://", "address"), (r"[a-z]+@[a-z]+", "mail"))


@query(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{label}')" for p, label in _SMELLS) + ") AS v(pattern, label)) SELECT rel, label, "
    "CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT rel, label, string_split_regex(text, pattern)[1] AS head FROM files, p WHERE regexp_matches(text, pattern))"
)
def c12_c13_smells_with_lines(spark: SparkSession, d: str) -> DataFrame:
    return tx.smells(documents(spark, d), _SMELLS)


_SIGNIFICANT = rf"""{_LINES}, sig AS (
  SELECT rel, line, {_NORMAL.replace('trim(x)', 'trim(raw)')} AS body, row_number() OVER (PARTITION BY rel ORDER BY line) - 1 AS ord
  FROM (SELECT rel, unnest(l) AS raw, unnest(generate_series(1, len(l))) AS line FROM lines) WHERE length(trim(raw)) >= 12 AND NOT regexp_matches(trim(raw), '^(#|//|\*|--|/\*)')
)"""


@query(f"WITH {_SIGNIFICANT} SELECT rel, CAST(line AS INTEGER) AS line, CAST(ord AS INTEGER) AS ord, md5(regexp_replace(body, '(^|[^0-9A-Za-z_])([0-9]+)($|[^0-9A-Za-z_])', '\\1NUM\\3', 'g')) AS digest FROM sig")
def c9_normalised_lines(spark: SparkSession, d: str) -> DataFrame:
    return tx.significant_lines(documents(spark, d)).select("rel", "line", "ord", F.md5(F.col("body").cast("binary")).alias("digest"))


_WINDOWS = f"""{_SIGNIFICANT}, win AS (
  SELECT rel, ord, line, md5(string_agg(regexp_replace(body, '(^|[^0-9A-Za-z_])([0-9]+)($|[^0-9A-Za-z_])', '\\1NUM\\3', 'g'), chr(10)) OVER w) AS digest, count(*) OVER w AS n FROM sig
  WINDOW w AS (PARTITION BY rel ORDER BY ord ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), places AS (SELECT rel, ord, line, digest FROM win WHERE n = 3)"""


@query(f"WITH {_WINDOWS} SELECT rel, CAST(ord AS INTEGER) AS ord, digest FROM places")
def w6_c10_window_digests(spark: SparkSession, d: str) -> DataFrame:
    return tx.windows(documents(spark, d), 3).select("rel", "ord", "digest")


CLONES = f"""{_SIGNIFICANT}, win AS (
  SELECT rel, ord, line, md5(string_agg(regexp_replace(body, '(^|[^0-9A-Za-z_])([0-9]+)($|[^0-9A-Za-z_])', '\\1NUM\\3', 'g'), chr(10)) OVER w) AS digest, count(*) OVER w AS n FROM sig
  WINDOW w AS (PARTITION BY rel ORDER BY ord ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), firsts AS (SELECT digest, min(ROW(rel, ord, line)) AS f FROM win WHERE n = 4 GROUP BY digest HAVING count(*) > 1),
pairs AS (SELECT f[1] AS f1, f[2] AS o1, f[3] AS l1, rel AS f2, ord AS o2, line AS l2 FROM win JOIN firsts USING (digest) WHERE n = 4),
runs AS (SELECT *, o1 - row_number() OVER (PARTITION BY f1, f2, o2 - o1 ORDER BY o1) AS island FROM pairs WHERE f1 <> f2 OR o2 >= o1 + 4),
found AS (SELECT f1 AS first_file, CAST(min(l1) AS INTEGER) AS first_line, f2 AS second_file, CAST(min(l2) AS INTEGER) AS second_line, CAST(count(*) + 3 AS BIGINT) AS lines FROM runs GROUP BY f1, f2, o2 - o1, island)"""


@query(f"WITH {CLONES} SELECT * FROM found")
def c11_w7_j4_clones(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at least four significant lines that occur again."""
    return tx.clones(documents(spark, d), least=4)


@query(f"WITH {_STATS}, c AS (SELECT rel, total_lines FROM stats) SELECT rel, CAST(total_lines AS BIGINT) AS total_lines, long_lines / code_lines::DOUBLE AS ratio FROM c JOIN stats USING (rel, total_lines) WHERE code_lines >= 20 AND long_lines / code_lines::DOUBLE > 0.15")
def rule_long_lines(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array(F.struct("total_lines", "code_lines", "long_lines"))
    s = tx.line_stats(documents(spark, d), comment="#").select("rel", F.inline_outer(counts))  # filters stop at an outer generator; pushed below, they would split every text anew for each count
    return s.filter(F.col("code_lines") >= 20).withColumn("ratio", F.col("long_lines") / F.col("code_lines")).filter(F.col("ratio") > 0.15).select("rel", "total_lines", "ratio")


@query(
    "SELECT round(100.0 * count(*) FILTER (is_test) / count(*) FILTER (NOT is_test), 6) AS file_ratio, round(100.0 * sum(code_lines) FILTER (is_test) / sum(code_lines) FILTER (NOT is_test), 6) AS line_ratio FROM file_stats"
)
def a18_test_ratios(spark: SparkSession, d: str) -> DataFrame:
    s, t = file_stats(spark, d), F.col("is_test")
    return s.agg(
        F.round(100.0 * F.count_if(t) / F.count_if(~t), 6).alias("file_ratio"),
        F.round(100.0 * F.sum(F.when(t, F.col("code_lines"))) / F.sum(F.when(~t, F.col("code_lines"))), 6).alias("line_ratio"),
    )


@query(
    "SELECT rel, kind FROM (SELECT rel, unnest([CASE WHEN total_lines > 500 AND NOT is_test OR total_lines > 800 THEN 'complexity.large_file' END, CASE WHEN max_depth > 4 AND NOT is_test THEN 'complexity.deep_nesting' END, "
    "CASE WHEN peak_complexity > 12 AND NOT is_test THEN 'complexity.complex_function' END]) AS kind FROM file_stats) WHERE kind IS NOT NULL"
)
def rule_complexity_thresholds(spark: SparkSession, d: str) -> DataFrame:
    s, source = file_stats(spark, d), ~F.col("is_test")
    large = F.when((F.col("total_lines") > 500) & source | (F.col("total_lines") > 800), "complexity.large_file")
    deep = F.when((F.col("max_depth") > 4) & source, "complexity.deep_nesting")
    branchy = F.when((F.col("peak_complexity") > 12) & source, "complexity.complex_function")
    return s.select("rel", F.explode(F.array_compact(F.array(large, deep, branchy))).alias("kind"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def a_conversation_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
