"""The measurements of a run, by part: one row each, or a short list, as DataFrames over the audit's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_name, human_bytes, percent
from ..operators import history as hi
from ..operators import paths as pt


def _total(column: str, when: Column | None = None) -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column)).otherwise(0)
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _share(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(percent(part.cast("double"), whole.cast("double")), places)


def complexity(stats: DataFrame) -> DataFrame:
    """One row: lines by kind, files by how they were measured, the deepest nesting, files that do not parse (at most 20)."""
    test = F.col("is_test")
    one = stats.agg(
        _total("total_lines").alias("total_lines"), _total("code_lines").alias("code_lines"), _total("code_lines", ~test).alias("source_code_lines"), _total("code_lines", test).alias("test_code_lines"),
        _total("comment_lines").alias("comment_lines"), _total("blank_lines").alias("blank_lines"), F.count("*").alias("files_measured"), F.count_if(F.col("metrics.exact")).alias("files_exact"),
        F.count_if(~F.col("metrics.exact")).alias("files_heuristic"), F.coalesce(F.max("metrics.max_depth"), F.lit(0)).alias("max_nesting_depth"),
    )
    return one.withColumn("comment_ratio", _share(F.col("comment_lines"), F.greatest(F.lit(1), F.col("code_lines") + F.col("comment_lines"))))


def parse_failures(stats: DataFrame, most: int = 20) -> DataFrame:
    return stats.filter("metrics.parse_error is not null").select("rel").orderBy("rel").limit(most)


def languages(stats: DataFrame) -> DataFrame:
    """(language, files, code_lines), the largest first."""
    return stats.groupBy("language").agg(F.count("*").alias("files"), _total("code_lines").alias("code_lines")).orderBy(F.desc("code_lines"), "language")


def largest_files(stats: DataFrame, most: int = 10) -> DataFrame:
    """(file, lines, code) of the longest source files."""
    return stats.filter(~F.col("is_test")).select(F.col("rel").alias("file"), F.col("total_lines").alias("lines"), F.col("code_lines").alias("code")).orderBy(F.desc("lines"), "file").limit(most)


def longest_functions(stats: DataFrame, most: int = 10) -> DataFrame:
    """(file, function, lines, complexity, line) of the longest functions in source files."""
    f = stats.filter(~F.col("is_test")).select("rel", F.explode("metrics.functions").alias("f"))
    rows = f.select(F.col("rel").alias("file"), F.col("f.name").alias("function"), F.col("f.length").alias("lines"), F.col("f.complexity").alias("complexity"), F.col("f.line").alias("line"))
    return rows.orderBy(F.desc("lines"), "file", "line").limit(most)


def tests(stats: DataFrame, asserted: DataFrame) -> DataFrame:
    """One row: test and source files and lines, their ratios, assertions. asserted: (code_lines, n) of the test files."""
    test = F.col("is_test")
    one = stats.agg(F.count_if(test).alias("test_files"), F.count_if(~test).alias("source_files"), _total("code_lines", test).alias("test_code_lines"), _total("code_lines", ~test).alias("source_code_lines"))
    one = one.join(F.broadcast(asserted.agg(_total("n").alias("assertions"))))  # one row each
    return one.select(
        "test_files", "source_files", _share(F.col("test_files"), F.greatest(F.lit(1), "source_files")).alias("test_file_ratio"), "test_code_lines", "source_code_lines",
        _share(F.col("test_code_lines"), F.greatest(F.lit(1), "source_code_lines")).alias("test_loc_ratio"), "assertions",
        _share(F.col("assertions"), F.greatest(F.lit(1), "test_code_lines"), 2).alias("assertions_per_100_lines"),
    )


def hotspots(history: DataFrame, commits: DataFrame, measured: DataFrame, least_commits: int) -> DataFrame:
    """One row: commits, files and people of the window, and the churn of all files that qualify as hotspots."""
    known = history.join(measured.filter("NOT is_test AND total_lines > 0").select(F.col("rel").alias("path")), "path", "left_semi").filter(F.col("commits") >= least_commits)
    people = commits.agg(F.count("*").alias("commits_in_window"), F.count_distinct("author").alias("contributors_in_window"))
    one = people.join(F.broadcast(history.agg(F.count("*").alias("files_changed"))))
    return one.join(F.broadcast(known.agg(_total("churn").alias("churn_total"))))


def hotspot_rows(ranked: DataFrame, now: int) -> DataFrame:
    """(file, commits, churn, complexity, score, lines, owner, authors, days_since_change) by rank."""
    return ranked.orderBy("rank").select(
        F.col("path").alias("file"), "commits", "churn", F.round("complexity", 2).alias("complexity"), F.round("score", 1).alias("score"), F.col("total_lines").alias("lines"), "owner", "authors",
        ((now - F.col("last_ts")) / float(hi.DAY)).alias("days_since_change"),
    )


def conventions(raw: DataFrame, least_chars: int, limit: int) -> DataFrame:
    """One row: the README and whether it says something, continuous integration, commit hooks, files above a size limit."""
    rel = F.col("rel")
    readme = file_name(rel).isin(pt.CUSTOMARY[0][1])
    first = F.min(F.when(readme, F.struct(F.length("rel").alias("n"), "rel", "size")))
    one = raw.agg(
        first.alias("first"), (F.count_if(pt.starts_any(rel, pt.CI_FILES)) > 0).alias("has_ci"), (F.count_if(pt.starts_any(rel, pt.HOOK_FILES)) > 0).alias("has_pre_commit"),
        F.count_if(F.col("size") > limit).alias("large_file_count"),
    )
    return one.select(F.col("first.rel").alias("readme"), F.coalesce(F.col("first.size") >= least_chars, F.lit(False)).alias("readme_substantive"), "has_ci", "has_pre_commit", "large_file_count")


def large_files(raw: DataFrame, limit: int, most: int = 20) -> DataFrame:
    """(file, bytes, human) of the largest files above a limit."""
    return raw.filter(F.col("size") > limit).select(F.col("rel").alias("file"), F.col("size").alias("bytes"), human_bytes(F.col("size")).alias("human")).orderBy(F.desc("bytes"), "file").limit(most)


def commit_history(commits: DataFrame, history: DataFrame, now: int) -> DataFrame:
    """One row: cadence, longest pause, people, bus factor, thin ownership, merges and subjects of the window."""
    totals = hi.author_totals(commits)
    out = hi.cadence(commits, now).select(F.col("commits").alias("commits_in_window"), F.round("commits_per_day", 3).alias("commits_per_day"), F.round("days_observed", 1).alias("days_observed"))
    parts = [
        hi.gaps(commits, now).select(F.round("dry_spell_days", 1).alias("longest_dry_spell_days")),
        totals.agg(F.count("*").alias("contributors")),
        hi.bus_factor(commits).agg(F.first("bus_factor").alias("bus_factor"), F.round(F.first("share"), 3).alias("bus_factor_share")),
        hi.thin_owners(history, totals).select(F.col("unowned_files").alias("single_owner_file_count"), F.col("owners").alias("file_owner_count")),
        hi.merge_ratio(commits).select(F.col("merges").alias("merge_commits"), F.round("merge_ratio", 3).alias("merge_ratio")),
        hi.subject_ratios(commits).select(
            F.round(100 * F.col("conventional_ratio"), 1).alias("conventional_commit_ratio"), F.round(100 * F.col("ticket_ratio"), 1).alias("ticket_reference_ratio"), F.round("mean_length", 1).alias("avg_subject_length")
        ),
    ]
    for part in parts:  # aggregates of one row each
        out = out.join(F.broadcast(part))
    return out


def dependencies(found: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: manifests and dependencies by group."""
    group = lambda g: F.count_if(F.col("grp") == g)
    one = deps.agg(F.count("*").alias("dependencies_total"), group("prod").alias("dependencies_prod"), group("dev").alias("dependencies_dev"), group("optional").alias("dependencies_optional"))
    return found.agg(F.count("*").alias("manifest_count")).join(F.broadcast(one))


def online(wanted: DataFrame, pending: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: dependencies asked about, answers from the cache, requests made, dependencies affected and their advisories."""
    hits = wanted.join(matches, "key")
    one = wanted.agg(F.count("*").alias("queried")).join(F.broadcast(pending.agg(F.count("*").alias("fetched"))))
    one = one.join(F.broadcast(hits.agg(F.count_distinct("name", "manifest", "version").alias("affected"), F.count_distinct("key", "id").alias("advisories"))))
    return one.withColumn("cache_hits", F.col("queried") - F.col("fetched"))


def capped_rules(findings: DataFrame, most: int) -> DataFrame:
    """(rule, dropped): findings beyond the cap of a rule."""
    return findings.groupBy("rule").agg(F.count("*").alias("n")).filter((F.col("n") > most) & F.lit(most > 0)).select("rule", (F.col("n") - most).alias("dropped")).orderBy("rule")
