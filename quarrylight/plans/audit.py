"""The audit of one source tree: from files, history and manifests to findings, scores and a report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import RULES
from ..config import Settings
from ..functions import scalars as sc
from ..functions.code import with_metrics
from ..operators import deps as dp
from ..operators import findings as fi
from ..operators import history as hi
from ..operators import paths as pt
from ..operators import text as tx
from ..operators.frameworks import frameworks
from ..sources import advisories as ad
from ..sources.git import git, register
from ..sources.manifests import manifests
from . import metrics as mt

_SEVERITY = {r.id: r.severity for r in RULES}
PLACES = "array<struct<file:string,line:bigint>>"


def finding(
    df: DataFrame, rule: str, detail: Column, file: Column | None = None, line: Column | None = None, severity: Column | None = None, confidence: Column | str = "high",
    evidence: list[Column] | Column | None = None, places: Column | None = None, occurrences: Column | None = None,
) -> DataFrame:
    """Rows of df as findings of a rule. evidence: what it rests on; places: further locations, else the one of file and line."""
    none = F.lit(None)
    here = F.struct((none if file is None else file).cast("string").alias("file"), (none if line is None else line).cast("bigint").alias("line"))
    told = F.array() if evidence is None else F.array_compact(F.array(*[e.cast("string") for e in evidence])) if isinstance(evidence, list) else evidence
    return df.select(
        F.lit(rule).alias("rule"), F.lit(rule.split(".")[0]).alias("dimension"), (severity if severity is not None else F.lit(_SEVERITY[rule])).alias("severity"),
        (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), detail.cast("string").alias("detail"),
        (none if file is None else file).cast("string").alias("file"), (none if line is None else line).cast("bigint").alias("line"), (F.lit(1) if occurrences is None else occurrences).cast("bigint").alias("occurrences"),
        told.cast("array<string>").alias("evidence"), (F.array(here) if places is None else places).cast(PLACES).alias("locations"),
    )


def folded(places: DataFrame, rule: str, what: str, confidence: str = "high") -> DataFrame:
    """Places (rel, label, line) as one finding: the first ten as evidence, the first twenty as locations, all as occurrences.

    The first places are cut before they are gathered, so no long list is built."""
    n = places.agg(F.count("*").alias("n"), F.count_distinct("rel").alias("files")).filter("n > 0")
    first = places.orderBy("rel", "line", "label").limit(20).agg(F.array_sort(F.collect_list(F.struct("rel", "line", "label"))).alias("p"))
    one = n.join(F.broadcast(first))  # one row each
    at = lambda x: F.concat(x["rel"], F.lit(":"), x["line"].cast("string"))
    told = F.transform(F.slice("p", 1, 10), lambda x: F.concat(at(x), F.lit(" "), x["label"]))
    where = F.transform("p", lambda x: F.struct(x["rel"].alias("file"), x["line"].cast("bigint").alias("line")))
    head, detail = F.get("p", F.lit(0)), F.concat("n", F.lit(f" {what} in "), "files", F.lit(" files"))
    return finding(one, rule, detail, head["rel"], head["line"], confidence=confidence, evidence=told, places=where, occurrences=F.col("n"))


@dataclass
class Audit:
    """Tables of one run; what could not be measured is in unavailable, by dimension, with the reason.

    measured: (part, key, row json): the measurements of each part, one row without a key, and lists by key."""

    files: DataFrame
    findings: DataFrame
    scores: DataFrame
    card: DataFrame
    measured: DataFrame
    metrics: dict[str, object] = field(default_factory=dict)
    unavailable: dict[str, str] = field(default_factory=dict)


def audit(spark: SparkSession, root: str, settings: Settings | None = None, now: int | None = None, only: set[str] | None = None, fetch=None) -> Audit:
    """Measures the tree at root; fetch, if given, answers for the advisory database. Rows that describe single files are made in parallel; the report's tables are small."""
    settings, now = settings or Settings(), int(now if now is not None else time.time())
    register(spark)
    options = {"root": root, "exclude": "\n".join(settings.excludes), "include": "\n".join(settings["include"]), "max_file_bytes": str(settings["max_file_bytes"])}
    raw = spark.read.format("source_tree").options(**options).load().persist()
    files = pt.with_language(raw.filter("excluded is null"))
    files = files.withColumn("is_test", pt.is_test(F.col("rel"), F.col("is_source"))).withColumn("is_manifest", F.col("name").isin(list(pt.MANIFESTS)))
    stats = with_metrics(tx.line_stats(files.filter("is_source"), long_chars=settings["long_line_chars"])).persist()
    log = spark.read.format("git_log").option("root", root).load().persist()
    commits = hi.since(log, now, settings["history_window_days"])
    changes = log.select("sha", F.explode("changes").alias("c")).select("sha", "c.*")
    is_git = bool(git(root, "rev-parse", "HEAD").strip())
    n_commits = commits.count()
    out: list[DataFrame] = []
    unavailable: dict[str, str] = {}
    metrics: dict[str, object] = {"now": now, "commits_in_window": n_commits, "files": files.count()}
    measured: list[DataFrame] = []

    def measure(part: str, df: DataFrame, key: str = "") -> None:
        """df as measurements of a part: one row of them, or with a key a short list."""
        measured.append(df.select(F.lit(part).alias("part"), F.lit(key).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")))

    how_many = lambda df, name: df.agg(F.count("*").alias(name))
    rel, code = F.col("rel"), ~F.col("is_test")

    # complexity
    parsed = stats.filter("metrics.parse_error is null")
    out.append(finding(stats.filter("metrics.parse_error is not null"), "complexity.parse_error", F.col("metrics.parse_error"), rel))
    out.append(finding(stats.filter("total_lines = 0 and size > 0"), "complexity.empty_file", F.lit("no lines"), rel))
    large = (F.col("total_lines") > settings["large_file_lines"]) & code | (F.col("total_lines") > settings["test_file_lines"])
    out.append(finding(parsed.filter(large & code), "complexity.large_file", F.concat("total_lines", F.lit(" lines")), rel))
    out.append(finding(parsed.filter(large & ~code), "tests.large_test_file", F.concat("total_lines", F.lit(" lines")), rel))
    source = parsed.filter(code)
    long_share = F.try_divide(F.col("long_lines"), F.col("code_lines"))
    out.append(finding(source.filter((F.col("code_lines") >= 20) & (long_share > settings["max_long_line_ratio"])), "complexity.long_lines", F.concat("long_lines", F.lit(" long lines")), rel))
    out.append(finding(source.filter(F.col("metrics.max_depth") > settings["max_nesting_depth"]), "complexity.deep_nesting", F.concat(F.lit("depth "), F.col("metrics.max_depth")), rel))
    functions = source.select("rel", F.col("metrics.exact").alias("exact"), F.explode("metrics.functions").alias("f"))
    sure = F.when(F.col("exact"), "high").otherwise("heuristic")
    for column, rule, limit in (("length", "complexity.long_function", "long_function_lines"), ("complexity", "complexity.complex_function", "complex_function_score"), ("args", "complexity.many_parameters", "max_parameters")):
        hit = functions.filter(F.col(f"f.{column}") > settings[limit])
        told = [F.concat(F.lit("lines "), F.col("f.line"), F.lit(" to "), F.col("f.end_line")), F.concat(F.lit(f"limit {settings[limit]}"))]
        out.append(finding(hit, rule, F.concat("f.name", F.lit(f": {column} "), F.col(f"f.{column}")), rel, F.col("f.line"), confidence=sure, evidence=told))
    clones = tx.clones(files.filter("is_source").select("rel", "text"), settings["duplication_min_lines"]).persist()
    shown = clones.orderBy(F.desc("lines"), "first_file", "first_line", "second_file", "second_line").limit(40)
    both = F.array(*[F.struct(F.col(f"{x}_file").alias("file"), F.col(f"{x}_line").alias("line")) for x in ("first", "second")])
    out.append(finding(shown, "complexity.duplication", F.concat("lines", F.lit(" lines again in "), "second_file"), F.col("first_file"), F.col("first_line"), places=both))
    measure("complexity", mt.complexity(stats))
    measure("complexity", how_many(clones, "duplication_blocks").withColumn("duplication_truncated", F.lit(False)))
    for key, df in (("languages", mt.languages(stats)), ("largest_files", mt.largest_files(stats)), ("longest_functions", mt.longest_functions(stats)), ("parse_failures", mt.parse_failures(stats))):
        measure("complexity", df, key)

    # hotspots
    history = hi.file_history(commits, changes)
    peak = F.coalesce(F.array_max(F.transform("metrics.functions", lambda f: f["complexity"])), F.lit(0))
    sizes = stats.select("rel", "total_lines", "is_test", F.col("metrics.max_depth").alias("max_depth"), peak.alias("peak_complexity"), F.col("metrics.exact").alias("exact"))
    bare = changes.agg(F.count("*").alias("n")).filter(F.col("n") == 0) if n_commits else changes.limit(0)
    out.append(finding(bare, "hotspots.history_unavailable", F.lit("commits without file changes")))
    measure("hotspots", mt.hotspots(history, commits, sizes, settings["hotspot_min_commits"]).withColumn("window_days", F.lit(settings["history_window_days"])))
    if n_commits < 3:
        unavailable["hotspots"] = "fewer than three commits in the window"
    else:
        ranked = hi.hotspots(history, sizes, settings["hotspot_min_commits"]).persist()
        if ranked.isEmpty():
            unavailable["hotspots"] = "no file was changed often enough"
        measure("hotspots", mt.hotspot_rows(ranked, now), "hotspots")
        told = [
            F.concat(F.lit("score "), F.round("score", 1)), F.concat(F.lit("churn "), "churn"), F.concat(F.lit("complexity index "), F.round("complexity", 2)),
            F.concat(F.lit("last changed "), F.round((now - F.col("last_ts")) / float(hi.DAY)).cast("bigint"), F.lit(" days ago")),
        ]
        out.append(finding(ranked, "hotspots.high_churn_complex", F.concat(F.lit("#"), "rank", F.lit(": "), "commits", F.lit(" commits over "), "total_lines", F.lit(" lines")), F.col("path"), severity=F.col("severity"), confidence=F.col("confidence"), evidence=told))
        out.append(finding(hi.sole_owner(ranked), "hotspots.sole_owner", F.lit("one author"), F.col("path"), severity=F.col("severity"), evidence=[F.concat(F.lit("author "), sc.mask_email(F.col("owner")))]))

    # tests
    tests = stats.filter("is_test")
    ratio = stats.agg(F.count_if("is_test").alias("t"), F.count_if(~F.col("is_test")).alias("s"), F.sum(F.when(F.col("is_test"), F.col("code_lines")).otherwise(0)).alias("tl"), F.sum(F.when(~F.col("is_test"), F.col("code_lines")).otherwise(0)).alias("sl"))
    low = (F.col("s") > 0) & ((F.try_divide("t", "s") < settings["test_min_ratio"]) | (F.try_divide("tl", "sl") < settings["test_min_ratio"]))
    out.append(finding(ratio.filter(low), "tests.low_ratio", F.concat("t", F.lit(" test files for "), "s")))
    tagged = files.select("rel", "is_source", "is_test")
    uncovered = pt.uncovered(tagged).persist()
    out.append(finding(uncovered, "tests.no_counterpart", F.concat("sources", F.lit(" source files")), F.col("dir")))
    asserted = tests.withColumn("n", tx.assertions(F.col("text")))
    out.append(finding(asserted.filter((F.col("code_lines") >= 30) & (F.col("n") == 0)), "tests.low_assertion_density", F.lit("no assertion"), rel, confidence="heuristic"))
    density = asserted.agg(F.sum("n").alias("n"), F.sum("code_lines").alias("lines")).filter((F.col("lines") > 0) & (100.0 * F.col("n") / F.col("lines") < settings["test_min_assertions_per_100_lines"]))
    out.append(finding(density, "tests.low_assertion_density", F.concat("n", F.lit(" assertions in "), "lines", F.lit(" lines")), confidence="heuristic"))
    empty = tests.select("rel", F.lit("empty").alias("label"), F.explode("metrics.empty_tests").alias("line"))
    smells = {"tests.skipped_leftover": (tx.smells(tests, tx.SKIPPED), "skipped or focused tests"), "tests.flaky_smell": (tx.smells(tests, tx.FLAKY), "unstable patterns"), "tests.empty_test": (empty, "empty tests")}
    smells = {rule: (places.persist(), what) for rule, (places, what) in smells.items()}
    out += [folded(places, rule, what, "high" if rule == "tests.empty_test" else "heuristic") for rule, (places, what) in smells.items()]
    measure("tests", mt.tests(stats, asserted))
    measure("tests", uncovered.select("dir").orderBy("dir").limit(1000), "uncovered_source_dirs")
    for rule, name in (("tests.skipped_leftover", "skipped_or_focused_files"), ("tests.flaky_smell", "flaky_smell_files"), ("tests.empty_test", "empty_test_files")):
        measure("tests", how_many(smells[rule][0], name))
    touched = hi.file_history(log, changes).select("path", "last_ts")
    pairs = pt.counterparts(tagged).join(touched.select(F.col("path").alias("test"), F.col("last_ts").alias("t_ts")), "test").join(touched.select(F.col("path").alias("source"), F.col("last_ts").alias("s_ts")), "source")
    stale = (F.col("t_ts") < now - settings["history_window_days"] * hi.DAY) & (F.col("s_ts") > F.col("t_ts"))
    stale_tests = pairs.filter(stale).persist()
    out.append(finding(stale_tests, "tests.stale", F.concat(F.lit("older than "), "source"), F.col("test"), evidence=[F.concat(F.lit("test last changed "), F.round((now - F.col("t_ts")) / float(hi.DAY)).cast("bigint"), F.lit(" days ago"))]))
    measure("tests", how_many(stale_tests, "stale_test_files"))
    if not is_git:
        unavailable["tests_history"] = "no history"

    # hygiene
    missing = pt.missing_files(raw).persist()
    for rule in ("hygiene.no_readme", "hygiene.missing_file"):
        out.append(finding(missing.filter(F.col("rule") == rule), rule, F.col("label"), severity=F.col("severity")))
    thin = raw.filter(sc.file_name(rel).isin(pt.CUSTOMARY[0][1]) & (F.col("size") < settings["min_readme_chars"]))
    out.append(finding(thin, "hygiene.no_readme", F.concat("size", F.lit(" bytes")), rel))
    ci = raw.agg(F.count_if(pt.starts_any(rel, pt.CI_FILES)).alias("n"))
    out.append(finding(ci.filter("n = 0"), "hygiene.no_ci", F.lit("none found")))
    large_blobs = mt.large_files(raw, settings["large_blob_bytes"], 10)
    out.append(finding(large_blobs, "hygiene.large_blob", F.col("human"), F.col("file"), evidence=[F.concat(F.lit("size "), "human")]))
    measure("hygiene", mt.conventions(raw, settings["min_readme_chars"], settings["large_blob_bytes"]))
    measure("hygiene", missing.select("label"), "missing_conventions")
    measure("hygiene", mt.large_files(raw, settings["large_blob_bytes"]), "large_files")
    if is_git and n_commits:
        measure("hygiene", mt.commit_history(commits, history, now))
        people = hi.author_totals(commits).agg(F.count("*").alias("n"))
        out.append(finding(people.filter("n = 1"), "hygiene.single_author", F.lit("one author")))
        bus = hi.bus_factor(commits).join(F.broadcast(people)).filter((F.col("n") > 1) & ((F.col("bus_factor") < settings["bus_factor_min_authors"]) | (F.col("share") > 0.8)))
        top = hi.author_totals(commits).orderBy(F.desc("commits"), "author").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("by"), "author", "commits"))).alias("top"))
        bus = bus.join(F.broadcast(top))
        names = F.array_join(F.transform("top", lambda x: F.concat(sc.mask_email(x["author"]), F.lit(" ("), x["commits"].cast("string"), F.lit(")"))), ", ")
        out.append(finding(bus, "hygiene.bus_factor", F.concat(F.lit("bus factor "), "bus_factor"), evidence=[F.concat(F.lit("contributors: "), "n"), F.concat(F.lit("top authors: "), names)]))
        pause = hi.gaps(commits, now).filter(F.col("dry_spell_days") > settings["dormant_days"])
        out.append(finding(pause, "hygiene.long_dry_spell", sc.human_days(F.col("dry_spell_days")), severity=F.when(F.col("dry_spell_days") > 2 * settings["dormant_days"], "medium").otherwise("low")))
        said = hi.subject_ratios(commits)
        out.append(finding(said.filter(F.col("conventional_ratio") < settings["conventional_commit_min_ratio"]), "hygiene.conventional_commits", F.round("conventional_ratio", 3)))
        merged = hi.merge_ratio(commits).filter((F.col("commits") >= 20) & ~F.col("merge_ratio").between(settings["min_merge_ratio"], settings["max_merge_ratio"]))
        out.append(finding(merged, "hygiene.merge_ratio", F.round("merge_ratio", 3), confidence="heuristic"))
    if is_git:
        idle = hi.gaps(log, now).filter(F.col("days_since_last") > settings["dormant_days"])
        out.append(finding(idle, "hygiene.dormant", sc.human_days(F.col("days_since_last")), severity=F.when(F.col("days_since_last") > 270, "high").otherwise("medium")))
        measure("hygiene", hi.gaps(log, now).select(F.round("days_since_last", 1).alias("days_since_last_commit")))
        refs = spark.read.format("git_refs").option("root", root).load().persist()
        out.append(finding(hi.stale_branches(refs, now, settings["dormant_branch_days"], 10), "hygiene.long_lived_branches", F.concat("branch", F.lit(": "), sc.human_days(F.col("age_days")))))
        measure("hygiene", hi.stale_branches(refs, now, settings["dormant_branch_days"], 20).select("branch", F.round("age_days", 1).alias("days")), "long_lived_branches")
        measure("hygiene", how_many(refs.filter(~F.col("is_current") & (F.col("ts") <= now - settings["dormant_branch_days"] * hi.DAY)), "long_lived_branch_count"))
    else:
        unavailable["hygiene_history"] = "no history"
        one = spark.range(1)
        out += [finding(one, "hygiene.history_unavailable", F.lit("no history")), finding(one, "tests.history_unavailable", F.lit("no history"))]

    # dependencies
    found = manifests(files).persist()
    deps = found.select("manifest", "ecosystem", F.explode("deps").alias("d")).select("manifest", "ecosystem", "d.*")
    out.append(finding(found.filter("error <> ''"), "deps.parse_error", F.col("error"), F.col("manifest")))
    out.append(finding(dp.unpinned(deps), "deps.unpinned_prod", F.concat("unpinned", F.lit(" of "), "total"), severity=F.col("severity")))
    out.append(finding(dp.version_skew(deps), "deps.version_skew", F.concat("package", F.lit(": "), F.array_join("versions", ", "))))
    out.append(finding(dp.declared_twice(deps), "deps.duplicate_declaration", F.col("name"), F.col("manifest")))
    out.append(finding(dp.test_only_in_production(deps), "deps.dev_in_prod", F.col("name"), F.col("manifest"), F.col("line")))
    locks = raw.withColumn("name", sc.file_name(rel)).select(rel.alias("path"), pt.mapped_lock(F.col("name")).alias("ecosystem")).filter("ecosystem is not null")
    out.append(finding(dp.without_lock(deps, locks), "deps.missing_lock", F.col("ecosystem")))
    times = lambda df: df.join(touched, "path", "left").select("path", "ecosystem", F.coalesce("last_ts", F.lit(0)).alias("mtime"))
    state = dp.lock_state(times(found.select(F.col("manifest").alias("path"), "ecosystem")), times(locks), touched)
    out.append(finding(state.filter("stale"), "deps.stale_lock", F.col("lock"), F.col("manifest")))
    recognised = frameworks(deps, files.filter("is_test")).persist()
    measure("tests", recognised.select("framework").orderBy("framework"), "frameworks")
    measure("deps", mt.dependencies(found, deps))
    measure("deps", dp.unpinned(deps).agg(F.coalesce(F.sum("unpinned"), F.lit(0)).alias("unpinned_prod_count")))
    for key, df in (("manifests", found.select("manifest")), ("parse_failures", found.filter("error <> ''").select("manifest")), ("lockfiles", locks), ("ecosystems", deps.groupBy("ecosystem").agg(F.count("*").alias("dependencies")))):
        measure("deps", df.orderBy(df.columns[0]).limit(1000), key)
    known = recognised.agg(F.count("*").alias("n")).join(F.broadcast(tests.agg(F.count("*").alias("tests"))))
    out.append(finding(known.filter("n = 0 and tests > 0"), "tests.no_framework", F.lit("none recognised")))
    if found.isEmpty():
        unavailable["deps"] = "no manifest"
    elif settings["online"] or fetch is not None:
        ask, cache = fetch or ad.http_fetcher(), settings["cache_dir"] or None
        wanted = dp.queryable(deps).persist()
        pending = dp.pending_keys(wanted, ad.read_cache(spark, cache).filter("kind = 'query'"), now, settings["cache_ttl_hours"]).persist()
        pending.count()  # before the cache is filled
        hits = ad.matches(ad.answers(wanted, "query", ask, cache, settings["cache_ttl_hours"], now))
        details = ad.advisories(ad.answers(hits.select(F.col("id").alias("key")), "advisory", ask, cache, settings["cache_ttl_hours"], now))
        bad = dp.vulnerable(wanted, hits, dp.advisory_severity(details)).persist()
        told = dp.advisory_evidence(bad, details)
        out.append(finding(told, "deps.vulnerability", F.concat("name", F.lit(" "), "version", F.lit(": "), F.array_join("advisories", ", ")), F.col("manifest"), severity=F.col("severity"), evidence=F.col("evidence"), occurrences=F.size("advisories")))
        measure("deps", mt.online(wanted, pending, hits), "online")
    else:
        metrics["advisories"] = "not asked: offline"

    rows = reduce(DataFrame.unionByName, out)
    if only:
        rows = rows.filter(F.col("dimension").isin(list(only)))
        unavailable |= {d: "not selected" for d in ("complexity", "hotspots", "tests", "hygiene", "deps") if d not in only}
    rows = rows.persist()  # ranked and counted
    findings = fi.capped(rows, settings["max_findings_per_rule"]).persist()
    measure("run", mt.capped_rules(rows, settings["max_findings_per_rule"]), "findings_capped")
    scores = fi.dimension_scores(findings, list(unavailable), settings.values).persist()
    return Audit(files, findings, scores, fi.scorecard(scores, settings.values), reduce(DataFrame.unionByName, measured), metrics | {"config": settings.digest()}, unavailable)
