"""Operators over commits and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONVENTIONAL, TICKET

DAY = 86_400


def since(commits: DataFrame, now: int, days: int) -> DataFrame:
    """The commits of the window that ends now; the filter reaches the scan."""
    return commits.filter(F.col("ts") >= now - days * DAY)


def file_history(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, commits, added, deleted, churn, last_ts, authors, owner): one row per changed path.

    Two aggregations: per path and author, which takes the hot paths' rows down before they are shuffled again, then
    per path. The owner has most commits, ties going to the greater name."""
    joined = changes.join(commits.select("sha", "author", "ts"), "sha")
    per_author = joined.groupBy("path", "author").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("ts").alias("last_ts"))
    return per_author.groupBy("path").agg(
        F.sum("n").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), (F.sum("added") + F.sum("deleted")).alias("churn"),
        F.max("last_ts").alias("last_ts"), F.count("*").alias("authors"), F.max_by("author", F.struct("n", "author")).alias("owner"),
    )


def author_totals(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("commits"))


def _running(totals: DataFrame) -> DataFrame:
    """Authors by falling commits with their running sum; as many rows as there are authors."""
    order = Window.orderBy(F.desc("commits"), F.asc("author"))
    return totals.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("commits").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def bus_factor(commits: DataFrame) -> DataFrame:
    """One row (bus_factor, share): the fewest authors that together made half of the commits, and their share.

    Ranks need one order over all authors. Only numbers of authors by their commit count go there: authors with equal
    counts are interchangeable, so there is one row per distinct count."""
    sizes = author_totals(commits).groupBy("commits").agg(F.count("*").alias("authors"))
    order = Window.orderBy(F.desc("commits"))
    before = sizes.select(
        "commits", "authors",
        (F.sum(F.col("commits") * F.col("authors")).over(order) - F.col("commits") * F.col("authors")).alias("done"),
        (F.sum("authors").over(order) - F.col("authors")).alias("ahead"),
        F.sum(F.col("commits") * F.col("authors")).over(Window.partitionBy()).alias("total"),
    )
    need = F.ceil((F.col("total") / 2.0 - F.col("done")) / F.col("commits"))
    hit = before.filter((F.col("done") < F.col("total") / 2.0) & (F.col("done") + F.col("commits") * F.col("authors") >= F.col("total") / 2.0))
    return hit.select((F.col("ahead") + need).cast("bigint").alias("bus_factor"), ((F.col("done") + need * F.col("commits")) / F.col("total")).alias("share"))


def gaps(commits: DataFrame, now: int, bucket_days: int = 30) -> DataFrame:
    """One row (dry_spell_days, days_since_last): the longest pause between commits, or since the last one.

    The order over time is cut into buckets, sorted each by itself; between buckets only first and last times meet."""
    buckets = commits.select("ts", F.floor(F.col("ts") / (bucket_days * DAY)).alias("bucket"))
    inner = buckets.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("bucket").orderBy("ts")))
    edges = inner.groupBy("bucket").agg(F.max("gap").alias("gap"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    joined = edges.withColumn("between", F.col("first") - F.lag("last").over(Window.orderBy("bucket")))
    one = joined.agg(F.max(F.greatest("gap", "between")).alias("gap"), F.max("last").alias("last"))
    return one.select((F.greatest(F.coalesce("gap", F.lit(0)), now - F.col("last")) / float(DAY)).alias("dry_spell_days"), ((now - F.col("last")) / float(DAY)).alias("days_since_last"))


def owner_counts(history: DataFrame) -> DataFrame:
    """(owner, files): how many files each author dominates."""
    return history.groupBy("owner").agg(F.count("*").alias("files"))


def thin_owners(history: DataFrame, totals: DataFrame) -> DataFrame:
    """One row (unowned_files, owners): files whose owner made no more than max(1, 5 %) of the commits."""
    limit = totals.agg(F.greatest(F.lit(1.0), 0.05 * F.sum("commits")).alias("limit"))
    rows = owner_counts(history).join(totals, F.col("owner") == F.col("author")).join(F.broadcast(limit))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("commits") <= F.col("limit"), F.col("files"))), F.lit(0)).alias("unowned_files"), F.count("*").alias("owners"))


def subject_ratios(subjects: DataFrame, column: str = "subject") -> DataFrame:
    """One row of what commit subjects look like."""
    s = F.col(column)
    n = F.greatest(F.count("*"), F.lit(1))
    return subjects.agg(
        F.count("*").alias("subjects"), (F.count_if(s.rlike(CONVENTIONAL)) / n).alias("conventional_ratio"), (F.count_if(s.rlike(TICKET)) / n).alias("ticket_ratio"),
        (F.coalesce(F.sum(F.length(s)), F.lit(0)) / n).alias("mean_length"), F.count_if(F.length(s) > 72).alias("over_72"),
    )


def merge_ratio(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), (F.count_if("is_merge") / F.greatest(F.count("*"), F.lit(1))).alias("merge_ratio"))


def cadence(commits: DataFrame, now: int) -> DataFrame:
    """One row (commits, days_observed, commits_per_day)."""
    one = commits.agg(F.count("*").alias("commits"), F.greatest(F.lit(1.0), (now - F.min("ts")) / float(DAY)).alias("days_observed"))
    return one.withColumn("commits_per_day", F.col("commits") / F.col("days_observed"))


def complexity_index() -> Column:
    """1 + lines / 400 + depth + the most complex function / 4."""
    return 1 + F.col("total_lines") / 400.0 + F.col("max_depth") + F.col("peak_complexity") / 4.0


def hotspots(history: DataFrame, stats: DataFrame, least_commits: int = 3, most: int = 20) -> DataFrame:
    """The files that are both complex and often changed: score = commits * complexity index, best ``most`` by score, path.

    Only the top rows reach one task, so ranking them by a window there is cheap."""
    joined = history.join(stats.filter(~F.col("is_test")).withColumnRenamed("rel", "path"), "path").filter(F.col("commits") >= least_commits)
    scored = joined.withColumn("complexity", complexity_index()).withColumn("score", F.col("commits") * F.col("complexity"))
    top = scored.orderBy(F.desc("score"), "path").limit(most)
    order = Window.orderBy(F.desc("score"), "path")
    ranked = top.withColumn("rank", F.row_number().over(order)).withColumn("share", F.col("score") / F.max("score").over(Window.partitionBy()))
    severity = F.when((F.col("share") >= 0.85) & (F.col("rank") <= 3), "high").when((F.col("share") >= 0.5) | (F.col("rank") <= 10), "medium").otherwise("low")
    return ranked.withColumn("severity", severity).withColumn("confidence", F.when(F.col("exact"), "high").otherwise("medium"))


def sole_owner(ranked: DataFrame) -> DataFrame:
    """The hotspots that one author alone changed, among the first ten."""
    return ranked.filter((F.col("authors") <= 1) & (F.col("rank") <= 10)).withColumn("severity", F.when(F.col("rank") <= 5, "medium").otherwise("low"))


def stale_branches(refs: DataFrame, now: int, days: float, most: int) -> DataFrame:
    """refs (branch, ts, is_current, ..) plus age_days: branches other than the current one whose tip is ``days`` old or older,
    the newest of them first."""
    old = refs.filter(~F.col("is_current") & (F.col("ts") <= now - days * DAY)).withColumn("age_days", (now - F.col("ts")) / float(DAY))
    return old.orderBy(F.desc("ts"), "branch").limit(most)
