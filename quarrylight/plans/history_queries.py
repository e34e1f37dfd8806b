"""Queries over commits, changes and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import CONFIDENCE_WEIGHT, DIMENSIONS, RULES, SEVERITY_PENALTY, SEVERITY_RANK, rules_frame
from ..config import DEFAULTS
from ..functions.scalars import CONVENTIONAL, TICKET
from ..operators import findings as fi
from ..operators import history as hi
from ..tables import table
from .mapping import NOW, changes, commits, file_stats
from .registry import query

NOW_S = 996_710_400  # NOW in epoch seconds
HISTORY = """history AS (
  SELECT path, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted,
    CAST(sum(added) + sum(deleted) AS BIGINT) AS churn, max(ts) AS last_ts, count(DISTINCT author) AS authors
  FROM changes JOIN commits USING (sha) GROUP BY path
), owners AS (
  SELECT path, arg_max(author, (n, author)) AS owner FROM (SELECT path, author, count(*) AS n FROM changes JOIN commits USING (sha) GROUP BY path, author) GROUP BY path
)"""
SCORED = f"""WITH {HISTORY}, scored AS (
  SELECT path, commits, churn, authors, owner, exact, 1 + total_lines / 400.0::DOUBLE + max_depth + peak_complexity / 4.0::DOUBLE AS complexity,
    commits * (1 + total_lines / 400.0::DOUBLE + max_depth + peak_complexity / 4.0::DOUBLE) AS score
  FROM history JOIN owners USING (path) JOIN file_stats ON rel = path WHERE NOT is_test AND commits >= 3
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank, score / max(score) OVER () AS share FROM scored
), top AS (
  SELECT *, CASE WHEN share >= 0.85 AND rank <= 3 THEN 'high' WHEN share >= 0.5 OR rank <= 10 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN exact THEN 'high' ELSE 'medium' END AS confidence
  FROM ranked WHERE rank <= 20
)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    return hi.file_history(commits(spark, d), changes(spark, d))


def _hotspots(spark: SparkSession, d: str) -> DataFrame:
    return hi.hotspots(_history(spark, d), file_stats(spark, d))


@query(f"{SCORED} SELECT path, commits, churn, authors, owner, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(share, 6) AS share, severity, confidence FROM top")
def w3_hotspot_rank(spark: SparkSession, d: str) -> DataFrame:
    """Hotspots: changes joined to commits and file metrics, aggregated, scored and ranked."""
    return _hotspots(spark, d).select("path", "commits", "churn", "authors", "owner", "rank", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "severity", "confidence")


@query(f"WITH {HISTORY} SELECT history.*, owner FROM history JOIN owners USING (path)")
def a1_file_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


@query("SELECT author, count(*) AS commits FROM commits GROUP BY author")
def a2_author_totals(spark: SparkSession, d: str) -> DataFrame:
    return hi.author_totals(commits(spark, d))


@query(f"WITH {HISTORY} SELECT path, owner FROM owners")
def a3_dominant_author(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("path", "owner")


@query(
    """WITH totals AS (SELECT author, count(*) AS n FROM commits GROUP BY author),
    run AS (SELECT n, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS total FROM totals WINDOW w AS (ORDER BY n DESC, author))
    SELECT CAST(min(k) AS BIGINT) AS bus_factor, round(CAST(min(s) AS DOUBLE) / CAST(min(total) AS DOUBLE), 9) AS share FROM run WHERE s >= total / 2.0"""
)
def a4_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return hi.bus_factor(commits(spark, d)).select("bus_factor", F.round("share", 9).alias("share"))


@query(
    f"""WITH g AS (SELECT ts, ts - lag(ts) OVER (ORDER BY ts) AS gap FROM commits)
    SELECT round(greatest(coalesce(max(gap), 0), {NOW_S} - max(ts)) / 86400.0::DOUBLE, 9) AS dry_spell_days, round(({NOW_S} - max(ts)) / 86400.0::DOUBLE, 9) AS days_since_last FROM g"""
)
def a5_dry_spell(spark: SparkSession, d: str) -> DataFrame:
    return hi.gaps(commits(spark, d), NOW_S).select(F.round("dry_spell_days", 9).alias("dry_spell_days"), F.round("days_since_last", 9).alias("days_since_last"))


@query(
    f"""WITH {HISTORY}, totals AS (SELECT author, count(*) AS n FROM commits GROUP BY author), files_of AS (SELECT owner, count(*) AS f FROM owners GROUP BY owner)
    SELECT CAST(coalesce(sum(f) FILTER (n <= (SELECT greatest(1.0::DOUBLE, 0.05::DOUBLE * sum(n)) FROM totals)), 0) AS BIGINT) AS unowned_files, count(*) AS owners
    FROM files_of JOIN totals ON owner = author"""
)
def a6_owner_counts(spark: SparkSession, d: str) -> DataFrame:
    return hi.thin_owners(_history(spark, d), hi.author_totals(commits(spark, d)))


@query("SELECT count(*) AS commits, count(*) FILTER (is_merge) AS merges, round(count(*) FILTER (is_merge) / count(*)::DOUBLE, 9) AS merge_ratio FROM commits")
def a7_merge_ratio(spark: SparkSession, d: str) -> DataFrame:
    return hi.merge_ratio(commits(spark, d)).withColumn("merge_ratio", F.round("merge_ratio", 9))


@query(
    f"""SELECT count(*) AS subjects, round(count(*) FILTER (regexp_matches(text, '{CONVENTIONAL}')) / count(*)::DOUBLE, 9) AS conventional_ratio,
    round(count(*) FILTER (regexp_matches(text, '{TICKET}')) / count(*)::DOUBLE, 9) AS ticket_ratio, round(sum(length(text)) / count(*)::DOUBLE, 6) AS mean_length,
    count(*) FILTER (length(text) > 72) AS over_72 FROM conversations"""
)
def a7_subject_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = hi.subject_ratios(table(spark, d, "conversations"), "text")
    return r.select("subjects", F.round("conventional_ratio", 9).alias("conventional_ratio"), F.round("ticket_ratio", 9).alias("ticket_ratio"), F.round("mean_length", 6).alias("mean_length"), "over_72")


@query(
    f"""SELECT count(*) AS commits, round(greatest(1.0::DOUBLE, ({NOW_S} - min(ts)) / 86400.0::DOUBLE), 6) AS days_observed,
    round(count(*) / greatest(1.0::DOUBLE, ({NOW_S} - min(ts)) / 86400.0::DOUBLE), 9) AS commits_per_day FROM commits"""
)
def a8_cadence(spark: SparkSession, d: str) -> DataFrame:
    return hi.cadence(commits(spark, d), NOW_S).select("commits", F.round("days_observed", 6).alias("days_observed"), F.round("commits_per_day", 9).alias("commits_per_day"))


@query(f"WITH {HISTORY} SELECT path, commits, churn, total_lines, max_depth FROM history JOIN file_stats ON rel = path")
def j1_history_with_stats(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).join(file_stats(spark, d), F.col("rel") == F.col("path")).select("path", "commits", "churn", "total_lines", "max_depth")


@query(
    """SELECT rel, CAST(coalesce(commits, 0) AS BIGINT) AS commits, code_lines FROM file_stats LEFT JOIN (SELECT path, count(*) AS commits FROM changes WHERE added > 45 GROUP BY path) ON rel = path"""
)
def j2_left_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    large = changes(spark, d).filter(F.col("added") > 45).groupBy("path").agg(F.count("*").alias("commits"))
    return file_stats(spark, d).join(large, F.col("rel") == F.col("path"), "left").select("rel", F.coalesce("commits", F.lit(0)).alias("commits"), "code_lines")


@query("SELECT sha, path, added, deleted FROM commits JOIN changes USING (sha)")
def j3_flattened_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each commit with its changes nested, and flattened again."""
    nested = changes(spark, d).groupBy("sha").agg(F.collect_list(F.struct("path", "added", "deleted")).alias("changes"))
    return commits(spark, d).join(nested, "sha").select("sha", F.explode("changes").alias("c")).select("sha", "c.path", "c.added", "c.deleted")


@query("SELECT CAST(l_orderkey AS BIGINT) AS sha FROM lineitem WHERE l_orderkey NOT IN (SELECT sha FROM commits WHERE ts >= 946684800)")
def j7_anti_join(spark: SparkSession, d: str) -> DataFrame:
    recent = commits(spark, d).filter(F.col("ts") >= 946_684_800)
    return changes(spark, d).join(recent, "sha", "left_anti").select("sha")


@query("SELECT DISTINCT path FROM changes WHERE path IN (SELECT rel FROM file_stats WHERE is_test)")
def a21_distinct_and_j9_semi(spark: SparkSession, d: str) -> DataFrame:
    tests = file_stats(spark, d).filter("is_test")
    return changes(spark, d).join(tests, F.col("path") == F.col("rel"), "left_semi").select("path").distinct()


@query(
    "WITH totals AS (SELECT author, count(*) AS commits FROM commits GROUP BY author) SELECT author, commits, CAST(row_number() OVER w AS INTEGER) AS rank, "
    "CAST(sum(commits) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM totals WINDOW w AS (ORDER BY commits DESC, author)"
)
def w4_cumulative_share(spark: SparkSession, d: str) -> DataFrame:
    return hi._running(hi.author_totals(commits(spark, d)))


@query("SELECT author, ts, coalesce(ts - lag(ts) OVER (PARTITION BY author ORDER BY ts), -1) AS gap FROM commits")
def w5_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("author").orderBy("ts")
    return commits(spark, d).select("author", "ts", F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(-1)).alias("gap"))


@query("WITH totals AS (SELECT author, count(*) AS commits FROM commits GROUP BY author) SELECT author, commits FROM totals ORDER BY commits DESC, author LIMIT 3")
def t6_top_authors(spark: SparkSession, d: str) -> DataFrame:
    return hi.author_totals(commits(spark, d)).orderBy(F.desc("commits"), "author").limit(3)


@query(f"{SCORED} SELECT path, CASE WHEN rank <= 5 THEN 'medium' ELSE 'low' END AS severity FROM top WHERE authors <= 1 AND rank <= 10")
def f18_sole_owner(spark: SparkSession, d: str) -> DataFrame:
    return hi.sole_owner(_hotspots(spark, d)).select("path", "severity")


@query(
    """SELECT path, count(*) AS commits, round(sum(added) * 1.0 / count(*), 6) AS mean_added FROM changes JOIN commits USING (sha)
    WHERE ts >= 996710400 - 180 * 86400 GROUP BY path"""
)
def s4_history_window(spark: SparkSession, d: str) -> DataFrame:
    """Only the window of the history is read: the bound on time reaches the scan."""
    recent = hi.since(commits(spark, d), NOW_S, DEFAULTS["history_window_days"])
    return changes(spark, d).join(recent, "sha").groupBy("path").agg(F.count("*").alias("commits"), F.round(F.sum("added") * 1.0 / F.count("*"), 6).alias("mean_added"))


@query(
    f"""SELECT sha, ts, ({NOW_S} - ts) / 86400.0::DOUBLE AS age_days FROM commits WHERE ts <= {NOW_S} - 90 * 86400 AND NOT is_merge ORDER BY ts DESC, sha LIMIT 20"""
)
def s9_t7_stale_branches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as branches, merged ones being current: the tips older than the limit, newest first, the first 20."""
    refs = commits(spark, d).select(F.col("sha").alias("branch"), "ts", F.col("is_merge").alias("is_current"))
    found = hi.stale_branches(refs, NOW_S, DEFAULTS["dormant_branch_days"], 20)
    return found.select(F.col("branch").alias("sha"), "ts", "age_days")


# ---- findings -------------------------------------------------------------------------------------------------------

CONFIDENCES = list(CONFIDENCE_WEIGHT)


def findings(spark: SparkSession, d: str) -> DataFrame:
    """events as findings: the rule by event_id, its catalogue severity, places by user."""
    e = table(spark, d, "events")
    pick = lambda values, index: F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
    rule = pick([r.id for r in RULES], F.col("event_id") % len(RULES))
    severity = pick([r.severity for r in RULES], F.col("event_id") % len(RULES))
    return e.select(
        rule.alias("rule"), F.split_part(rule, F.lit("."), F.lit(1)).alias("dimension"), severity.alias("severity"), pick(CONFIDENCES, F.col("user_id") % 3).alias("confidence"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line"), F.lit(1).cast("bigint").alias("occurrences"), "ts",
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(col: str, values: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'INTEGER'})" for k, v in values.items()) + " END"


FINDINGS = f"""f AS (
  SELECT {_list(r.id for r in RULES)}[event_id % {len(RULES)} + 1] AS rule, split_part({_list(r.id for r in RULES)}[event_id % {len(RULES)} + 1], '.', 1) AS dimension,
    {_list(r.severity for r in RULES)}[event_id % {len(RULES)} + 1] AS severity, {_list(CONFIDENCES)}[user_id % 3 + 1] AS confidence,
    'f' || CAST(user_id AS VARCHAR) AS file, event_id AS line, ts FROM events
), x AS (SELECT *, {_case('severity', SEVERITY_RANK)} AS severity_rank, {_case('severity', SEVERITY_PENALTY)} * {_case('confidence', CONFIDENCE_WEIGHT)} AS cost FROM f),
w AS (SELECT * EXCLUDE (cost), CAST(cost AS DECIMAL(6, 2)) AS penalty FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY severity_rank DESC, penalty DESC, rule, file, line) AS rn, count(*) OVER (PARTITION BY rule) AS n FROM w),
capped AS (SELECT * EXCLUDE (rn, n), CAST(1 + CASE WHEN rn = 12 THEN n - 12 ELSE 0 END AS BIGINT) AS occurrences FROM r WHERE rn <= 12)"""
BUDGET = {"complexity": 400.0, "hotspots": 300.0, "tests": 400.0, "hygiene": 100.0, "deps": 500.0}
SETTINGS = DEFAULTS | {"budget": BUDGET}
CARD = f"""points AS (SELECT dimension, CAST(sum(penalty) AS DOUBLE) AS points, count(*) AS n_findings, count(*) FILTER (severity = 'critical') AS n_critical FROM capped GROUP BY dimension),
dims AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {i}, CAST({BUDGET[x]} AS DOUBLE), CAST({DEFAULTS['weights'][x]} AS DOUBLE), {x != 'hotspots'})" for i, x in enumerate(DIMENSIONS))}) AS v(dimension, ordinal, budget, weight, measured)),
scores AS (
  SELECT dimension, ordinal, weight, coalesce(points, 0) AS points, coalesce(n_findings, 0) AS n_findings, coalesce(n_critical, 0) AS n_critical,
    CASE WHEN measured THEN 100.0 * (1 - least(1.0, coalesce(points, 0) / budget)) END AS score FROM dims LEFT JOIN points USING (dimension)
)"""
GRADE = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return fi.dimension_scores(fi.capped(findings(spark, d)), ["hotspots"], SETTINGS)


@query(f"WITH {FINDINGS} SELECT rule, file, line, severity_rank, CAST(penalty AS DOUBLE) AS penalty, occurrences FROM capped")
def w1_w2_capped_findings(spark: SparkSession, d: str) -> DataFrame:
    return fi.capped(findings(spark, d)).select("rule", "file", "line", "severity_rank", F.col("penalty").cast("double").alias("penalty"), "occurrences")


@query(f"WITH {FINDINGS} SELECT rule, file, line, CAST(row_number() OVER (ORDER BY severity_rank DESC, penalty DESC, rule, file, line) AS INTEGER) AS place FROM capped")
def t1_finding_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of report over capped findings, of which there are a dozen for each rule at most."""
    return fi.capped(findings(spark, d)).select("rule", "file", "line", F.row_number().over(Window.orderBy(*fi.order_by())).alias("place"))


@query(f"WITH {FINDINGS} SELECT dimension, CAST(sum(penalty) AS DOUBLE) AS points, count(*) AS n_findings FROM w GROUP BY dimension")
def a11_a12_penalty_totals(spark: SparkSession, d: str) -> DataFrame:
    return fi.penalty_totals(fi.weighed(findings(spark, d))).select("dimension", "points", "n_findings")


@query(
    f"WITH {FINDINGS}, {CARD} SELECT dimension, CAST(ordinal AS INTEGER) AS ordinal, round(score, 6) AS score, {GRADE.format('score')} AS grade, CAST(n_findings AS BIGINT) AS n_findings, weight FROM scores"
)
def g1_g4_f2_f3_dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of capped findings; a dimension that was not measured stays null."""
    return _scores(spark, d).select("dimension", "ordinal", F.round("score", 6).alias("score"), "grade", "n_findings", "weight")


_OVERALL = "least(uncapped, CASE WHEN n_critical > 0 THEN 89.0 ELSE 100.0 END)"


@query(
    f"""WITH {FINDINGS}, {CARD}, one AS (SELECT CAST(sum(CAST(score AS DECIMAL(20, 9)) * CAST(weight AS DECIMAL(10, 4))) AS DOUBLE) / sum(weight) FILTER (score IS NOT NULL) AS uncapped, sum(weight) FILTER (score IS NOT NULL) / sum(weight) AS coverage,
    CAST(sum(n_critical) AS BIGINT) AS n_critical FROM scores)
    SELECT round({_OVERALL}, 6) AS overall, {GRADE.format(_OVERALL)} AS grade, round(uncapped, 6) AS uncapped, round(coverage, 6) AS coverage, n_critical FROM one"""
)
def g2_g3_a13_f4_scorecard(spark: SparkSession, d: str) -> DataFrame:
    card = fi.scorecard(_scores(spark, d), SETTINGS)
    return card.select(F.round("overall", 6).alias("overall"), "grade", F.round("uncapped", 6).alias("uncapped"), F.round("coverage", 6).alias("coverage"), "n_critical")


@query(f"WITH {FINDINGS} SELECT rule, file, line FROM w WHERE severity_rank >= 3 ORDER BY severity_rank DESC, penalty DESC, rule, file, line LIMIT 1")
def g6_severity_gate(spark: SparkSession, d: str) -> DataFrame:
    return fi.worst(findings(spark, d), "high").select("rule", "file", "line")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = findings(spark, d)
    early = F.dayofmonth("ts") <= 15
    return f.filter(~early & ~F.col("rule").like("%test%")), f.filter(early & ~F.col("rule").like("%large%"))


DIFF = f"""WITH {FINDINGS}, cur AS (SELECT rule, count(*) AS after FROM w WHERE day(ts) > 15 AND rule NOT LIKE '%test%' GROUP BY rule),
base AS (SELECT rule, count(*) AS before FROM w WHERE day(ts) <= 15 AND rule NOT LIKE '%large%' GROUP BY rule),
diff AS (SELECT rule, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'resolved' WHEN after > before THEN 'increased' WHEN after < before THEN 'decreased' ELSE 'unchanged' END AS kind,
  CAST(coalesce(before, 0) AS BIGINT) AS before, CAST(coalesce(after, 0) AS BIGINT) AS after FROM cur FULL JOIN base USING (rule))"""


@query(f"{DIFF} SELECT * FROM diff")
def j11_g7_baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    return fi.compared(*_halves(spark, d))


@query(f"{DIFF} SELECT rule FROM diff WHERE kind = 'new'")
def u1_new_rules(spark: SparkSession, d: str) -> DataFrame:
    current, base = _halves(spark, d)
    return current.select("rule").subtract(base.select("rule"))


@query(f"{DIFF} SELECT rule FROM diff WHERE kind = 'resolved'")
def u2_resolved_rules(spark: SparkSession, d: str) -> DataFrame:
    current, base = _halves(spark, d)
    return base.select("rule").subtract(current.select("rule"))


@query(f"{DIFF} SELECT rule, before, after FROM diff WHERE kind IN ('increased', 'decreased')")
def u3_changed_rules(spark: SparkSession, d: str) -> DataFrame:
    return fi.compared(*_halves(spark, d)).filter(F.col("kind").isin("increased", "decreased")).select("rule", "before", "after")


@query(f"WITH {FINDINGS} SELECT dimension, count(*) AS n FROM (SELECT * FROM w WHERE dimension = 'deps' UNION ALL SELECT * FROM w WHERE dimension = 'tests') GROUP BY dimension")
def u4_union_all(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.filter("dimension = 'deps'").unionByName(f.filter("dimension = 'tests'")).groupBy("dimension").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS} SELECT file FROM w WHERE severity_rank >= 3 UNION SELECT file FROM w WHERE dimension = 'hygiene'")
def u5_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    f = fi.weighed(findings(spark, d))
    return f.filter("severity_rank >= 3").select("file").union(f.filter("dimension = 'hygiene'").select("file")).distinct()


_CATALOGUE = ", ".join(f"('{r.id}', '{r.dimension}', '{r.severity}')" for r in RULES)


@query(f"WITH {FINDINGS}, c AS (SELECT * FROM (VALUES {_CATALOGUE}) AS v(id, dim, sev)) SELECT rule, dim AS dimension, sev AS severity, count(*) AS n FROM f JOIN c ON id = rule GROUP BY ALL")
def j12_rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    rules = F.broadcast(rules_frame(spark).select(F.col("id").alias("rule"), F.col("dimension").alias("dim"), F.col("severity").alias("sev")))  # 44 rows
    return findings(spark, d).select("rule").join(rules, "rule").groupBy("rule", F.col("dim").alias("dimension"), F.col("sev").alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT dimension, count(*) AS n FROM (SELECT split_part(id, '.', 1) AS dimension FROM (VALUES {_CATALOGUE}) AS v(id, dim, sev)) GROUP BY dimension")
def k6_rule_listing(spark: SparkSession, d: str) -> DataFrame:
    return rules_frame(spark).groupBy("dimension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension")


assert NOW == "2001-08-02 00:00:00"
