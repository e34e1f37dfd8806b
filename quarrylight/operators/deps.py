"""Operators over declared dependencies and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import SEVERITY_RANK, mapped, severity_rank
from ..functions.scalars import ADVISORY_ECOSYSTEM, advisory_key, cvss_base, extract_version, is_pinned, is_test_only, score_severity, skew_key

#: deps: manifest, ecosystem, name, spec, grp (prod, dev, optional, peer), line.


def unpinned(deps: DataFrame) -> DataFrame:
    """(ecosystem, unpinned, total, share, severity) of ecosystems with floating production dependencies."""
    floating = (F.col("grp") == "prod") & ~is_pinned(F.col("spec"), F.col("ecosystem"))
    one = deps.groupBy("ecosystem").agg(F.count_if(floating).alias("unpinned"), F.count("*").alias("total")).filter(F.col("unpinned") > 0)
    return one.withColumn("share", F.col("unpinned") / F.col("total")).withColumn("severity", F.when(F.col("share") >= 0.5, "high").otherwise("medium"))


def version_skew(deps: DataFrame) -> DataFrame:
    """(package, versions, manifests): packages at two or more versions in two or more manifests."""
    rows = deps.select(skew_key(F.col("name"), F.col("ecosystem")).alias("package"), extract_version(F.col("spec"), F.col("ecosystem")).alias("version"), "manifest").filter(F.col("version").isNotNull())
    one = rows.groupBy("package").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count_distinct("manifest").alias("manifests"))
    return one.filter((F.size("versions") >= 2) & (F.col("manifests") >= 2))


def declared_twice(deps: DataFrame) -> DataFrame:
    """(manifest, name, specs): names that one manifest declares with different specs."""
    one = deps.groupBy("manifest", "name").agg(F.count("*").alias("n"), F.count_distinct("spec").alias("specs"))
    return one.filter((F.col("n") >= 2) & (F.col("specs") >= 2))


def test_only_in_production(deps: DataFrame) -> DataFrame:
    return deps.filter((F.col("grp") == "prod") & is_test_only(F.col("name")))


def counts(deps: DataFrame) -> DataFrame:
    return deps.agg(F.count("*").alias("total"), *[F.count_if(F.col("grp") == g).alias(g) for g in ("prod", "dev", "optional")])


def lock_state(manifests: DataFrame, locks: DataFrame, touched: DataFrame, slack_seconds: int = 86_400) -> DataFrame:
    """(manifest, ecosystem, lock, stale): each manifest with its ecosystem's lock, if any, and whether it is a day or more newer.

    manifests and locks: (path, ecosystem, mtime); touched: (path, last_ts) from the history, preferred to mtime. Of several
    locks the least path counts."""
    lock = locks.groupBy("ecosystem").agg(F.min(F.struct(F.col("path").alias("lock"), F.col("mtime").alias("lock_mtime"))).alias("l")).select("ecosystem", "l.*")
    rows = manifests.join(lock, "ecosystem", "left")
    times = lambda df, key, name: df.join(touched.select(F.col("path").alias(key), F.col("last_ts").alias(name)), key, "left")
    rows = times(times(rows.withColumnRenamed("path", "manifest"), "manifest", "m_ts"), "lock", "l_ts")
    newer = F.coalesce("m_ts", "mtime") - F.coalesce("l_ts", "lock_mtime")
    return rows.select("manifest", "ecosystem", "lock", F.coalesce(newer > slack_seconds, F.lit(False)).alias("stale"))


def without_lock(deps: DataFrame, locks: DataFrame) -> DataFrame:
    """Ecosystems with production dependencies and no lock."""
    return deps.filter("grp = 'prod'").select("ecosystem").distinct().join(locks, "ecosystem", "left_anti")


def queryable(deps: DataFrame) -> DataFrame:
    """Dependencies that an advisory database can be asked about, with their version and lookup key."""
    version = extract_version(F.col("spec"), F.col("ecosystem"))
    rows = deps.filter(F.col("grp").isin("prod", "optional") & F.col("ecosystem").isin(list(ADVISORY_ECOSYSTEM))).withColumn("version", version).filter(F.col("version").isNotNull())
    return rows.withColumn("key", advisory_key(F.col("name"), F.col("ecosystem"), F.col("version")))


def pending_keys(wanted: DataFrame, cache: DataFrame, now: int, ttl_hours: float = 24) -> DataFrame:
    """Distinct keys that no fresh cache row (key, fetched_at) answers."""
    fresh = cache.filter(F.col("fetched_at") >= now - int(ttl_hours * 3600))
    return wanted.select("key").distinct().join(fresh, "key", "left_anti")


def advisory_severity(advisories: DataFrame) -> DataFrame:
    """advisories (id, database_severity, scores array<struct<type, score>>, aliases array, ..) plus severity.

    The database's CRITICAL counts first; else the first usable score, version 3 before others; else an alias makes it high.
    Scores are rated as rows, one base score each, and the first is joined back."""
    each = advisories.select("id", F.posexplode("scores").alias("i", "s")).select("id", "i", F.col("s.type").alias("type"), F.col("s.score").alias("text"))
    each = each.withColumn("base", cvss_base(F.col("text"))).withColumn("plain", F.try_to_number("text", F.lit("99.99")).cast("double"))
    each = each.withColumn("value", F.when(F.upper("text").startswith("CVSS:"), F.col("base")).otherwise(F.col("plain"))).filter("value is not null")
    old = F.when(F.lower("type").contains("3") | F.upper("text").startswith("CVSS:3"), 0).otherwise(1)
    first = each.groupBy("id").agg(F.min_by("value", F.struct(old, F.col("i"))).alias("first_score"))
    known = score_severity(F.col("first_score"))
    severity = F.when(F.upper("database_severity") == "CRITICAL", "critical").otherwise(F.coalesce(known, F.when(F.size("aliases") > 0, "high").otherwise("medium")))
    return advisories.join(first, "id", "left").withColumn("severity", severity).drop("first_score")


def advisory_evidence(found: DataFrame, advisories: DataFrame, most: int = 8) -> DataFrame:
    """found (.., advisories array) plus evidence: of the first ``most`` advisories the id, up to three fixed versions and the
    beginning of the summary."""
    fixed = F.array_join(F.slice(F.array_sort(F.array_distinct("fixed")), 1, 3), ", ")
    said = F.concat("id", F.when(F.size("fixed") > 0, F.concat(F.lit(" (fixed in "), fixed, F.lit(")"))).otherwise(""), F.when(F.length("summary") > 0, F.concat(F.lit(": "), F.substring("summary", 1, 120))).otherwise(""))
    lines = advisories.select(F.col("id").alias("advisory"), said.alias("said"))
    first = found.select("name", "manifest", "version", F.posexplode(F.slice("advisories", 1, most)).alias("at", "advisory")).join(lines, "advisory", "left")
    told = first.groupBy("name", "manifest", "version").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("said", "advisory").alias("said")))).alias("told"))
    return found.join(told, ["name", "manifest", "version"], "left").withColumn("evidence", F.transform("told", lambda x: x["said"])).drop("told")


def vulnerable(wanted: DataFrame, matches: DataFrame, advisories: DataFrame) -> DataFrame:
    """(name, manifest, version, severity, advisories): dependencies with advisories, by the worst of them, medium at least.

    matches: (key, id); advisories: (id, severity)."""
    rows = wanted.join(matches, "key").join(advisories.select("id", "severity"), "id", "left")
    one = rows.groupBy("name", "manifest", "version").agg(F.greatest(F.lit(SEVERITY_RANK["medium"]), F.max(severity_rank("severity"))).alias("rank"), F.array_sort(F.collect_set("id")).alias("advisories"))
    return one.select("name", "manifest", "version", mapped("rank", {v: k for k, v in SEVERITY_RANK.items()}).alias("severity"), "advisories")
