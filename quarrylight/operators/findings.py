"""Findings: capping, ordering, scoring, gating and comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import DIMENSIONS, penalty, severity_rank
from ..config import DEFAULTS
from ..functions.scalars import dimension_score, grade

#: findings: rule, dimension, severity, confidence, file, line, occurrences and any other columns.


def order_by() -> list:
    """Severest first, then costliest, then by rule and place."""
    return [F.desc("severity_rank"), F.desc("penalty"), F.asc("rule"), F.asc("file"), F.asc("line")]


def weighed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", severity_rank("severity")).withColumn("penalty", penalty("severity", "confidence"))


def capped(findings: DataFrame, most: int = DEFAULTS["max_findings_per_rule"]) -> DataFrame:
    """The first ``most`` findings of each rule; what is dropped is counted in the last kept one's occurrences.

    most <= 0 keeps all. Ranking is by rule: Spark's group limit cuts each task's rows before the shuffle where only the
    kept rows are asked for; the count of the dropped ones is an aggregate of its own, joined back."""
    rows = weighed(findings)
    if most <= 0:
        return rows
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(*order_by()))
    kept = rows.withColumn("rn", rank).filter(F.col("rn") <= most)
    totals = rows.groupBy("rule").agg(F.count("*").alias("all_rows"))
    folded = kept.join(F.broadcast(totals), "rule")  # a row for each rule of the catalogue
    extra = F.when(F.col("rn") == most, F.col("all_rows") - most).otherwise(0)
    return folded.withColumn("occurrences", F.col("occurrences") + extra).drop("rn", "all_rows")


def penalty_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dimension").agg(F.sum("penalty").cast("double").alias("points"), F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "critical").alias("n_critical"))


def dimension_scores(findings: DataFrame, unavailable: list[str] | None = None, settings: dict = DEFAULTS) -> DataFrame:
    """(dimension, ordinal, score, grade, points, n_findings, n_critical, weight) of all five dimensions.

    A dimension that could not be measured has a null score, whatever its findings: unknown is not healthy."""
    spark: SparkSession = findings.sparkSession
    rows = [(d, i, float(settings["budget"][d]), float(settings["weights"][d]), d not in (unavailable or [])) for i, d in enumerate(DIMENSIONS)]
    dims = spark.createDataFrame(rows, "dimension string, ordinal int, budget double, weight double, measured boolean")
    joined = dims.join(penalty_totals(findings), "dimension", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = joined.withColumn("points", F.coalesce("points", F.lit(0.0))).withColumn("score", F.when(F.col("measured"), dimension_score(F.col("points"), F.col("budget"))))
    return out.select("dimension", "ordinal", "score", grade(F.col("score"), settings["grade_bands"]).alias("grade"), "points", zero("n_findings").alias("n_findings"), zero("n_critical").alias("n_critical"), "weight")


def scorecard(scores: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """One row (overall, grade, uncapped, coverage, n_critical): the weighted mean over measured dimensions, capped if a critical finding is open."""
    measured = F.col("score").isNotNull()
    exact = F.col("score").cast("decimal(20,9)") * F.col("weight").cast("decimal(10,4)")  # the same sum in any order
    one = scores.agg(
        F.try_divide(F.sum(F.when(measured, exact)).cast("double"), F.sum(F.when(measured, F.col("weight")))).alias("uncapped"),
        F.try_divide(F.sum(F.when(measured, F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("coverage"),
        F.sum("n_critical").alias("n_critical"),
    )
    cap = float(settings["critical_grade_cap"])
    overall = F.when((F.col("n_critical") > 0) & (F.col("uncapped") > cap), cap).otherwise(F.col("uncapped"))
    return one.select(overall.alias("overall"), grade(overall, settings["grade_bands"]).alias("grade"), "uncapped", "coverage", "n_critical")


def worst(findings: DataFrame, least: str) -> DataFrame:
    """The first finding at or above a severity, none if the gate is passed."""
    from ..catalogue import SEVERITY_RANK

    return weighed(findings).filter(F.col("severity_rank") >= SEVERITY_RANK[least]).orderBy(*order_by()).limit(1)


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"))


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rule, kind, before, after): new, resolved, increased, decreased or unchanged occurrences, by rule."""
    a = by_rule(baseline).select("rule", F.col("occurrences").alias("before"))
    b = by_rule(current).select("rule", F.col("occurrences").alias("after"))
    both = b.join(a, "rule", "full_outer")
    kind = (
        F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(F.col("after") > F.col("before"), "increased")
        .when(F.col("after") < F.col("before"), "decreased").otherwise("unchanged")
    )
    return both.select("rule", kind.alias("kind"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def score_deltas(current: DataFrame, baseline: DataFrame, least: float = 0.05) -> DataFrame:
    """(dimension, before, after, delta) where both were measured and differ by at least ``least``, all at one decimal."""
    a = baseline.select("dimension", F.round("score", 1).alias("before"))
    b = current.select("dimension", F.round("score", 1).alias("after"))
    rows = b.join(a, "dimension").withColumn("delta", F.round(F.col("after") - F.col("before"), 1))
    return rows.filter(F.abs("delta") >= least)
