"""The engine's tables: as read from real repositories, or mapped from the benchmark's star schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

#: The moment at which mapped histories are looked at.
NOW = "2001-08-02 00:00:00"


def epoch(col: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """commits(sha, author, ts epoch seconds, subject, is_merge) from orders."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), epoch("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject"), (F.col("o_orderstatus") == "F").alias("is_merge"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """changes(sha, path, added, deleted) from lineitem."""
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))


def file_stats(spark: SparkSession, d: str) -> DataFrame:
    """file_stats(rel, language, total_lines, code_lines, max_depth, peak_complexity, is_test, exact) from part."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("rel"), F.col("p_type").alias("language"), (40 * size).cast("bigint").alias("total_lines"), (30 * size).cast("bigint").alias("code_lines"),
        (size % 8).cast("bigint").alias("max_depth"), (size % 17).cast("bigint").alias("peak_complexity"), (F.col("p_partkey") % 5 == 0).alias("is_test"), (size % 3 != 0).alias("exact"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    """files(rel, text, size, language) from documents; rel is source/lang/doc_id."""
    t = table(spark, d, "documents")
    return t.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel"), "text", F.col("n_chars").alias("size"), F.col("lang").alias("language"))


def spread(rows: DataFrame, per_task: int = 10_000) -> DataFrame:
    """rows dealt anew over tasks of about ``per_task``: a table of narrow rows stands in few blocks of a file, so that what is
    costly to make of each row would be made in as few tasks."""
    return rows.repartition(rows.count() // per_task + 1)


#: The same tables in SQL, for the oracle.
SQL = {
    "commits": "SELECT o_orderkey AS sha, o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS subject, o_orderstatus = 'F' AS is_merge FROM orders",
    "changes": "SELECT l_orderkey AS sha, l_partkey AS path, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM lineitem",
    "file_stats": "SELECT p_partkey AS rel, p_type AS language, CAST(40 * p_size AS BIGINT) AS total_lines, CAST(30 * p_size AS BIGINT) AS code_lines, CAST(p_size % 8 AS BIGINT) AS max_depth, "
    "CAST(p_size % 17 AS BIGINT) AS peak_complexity, p_partkey % 5 = 0 AS is_test, p_size % 3 <> 0 AS exact FROM part",
    "files": "SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS rel, text, n_chars AS size, lang AS language FROM documents",
}


def with_tables(sql: str) -> str:
    """sql with the mapped tables that it names put before it."""
    used = [f"{name} AS ({body})" for name, body in SQL.items() if re.search(rf"\b{name}\b", sql)]
    rest = sql.lstrip()
    if not used:
        return rest
    return "WITH " + ",\n".join(used) + ("\n, " + rest[4:] if rest.upper().startswith("WITH") else "\n" + rest)
