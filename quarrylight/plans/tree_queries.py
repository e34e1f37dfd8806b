"""Queries over paths, dependencies and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import deps as dp
from ..operators import paths as pt
from ..tables import table
from .registry import query

DIRS = ["src", "src/app", "tests", "lib", "docs", "node_modules/x", "tests/app", "."]
STEMS = ["main", "test_main", "util", "README", "config", "main_test", "index", "conftest"]
ENDS = [".py", ".js", ".md", ".go", ".min.js", ".json", ".rs", ".test.ts"]


def _pick(values: list[str], index) -> F.col:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS BIGINT) + 1]"


def paths(spark: SparkSession, d: str) -> DataFrame:
    """files(rel) with names made from part keys."""
    k = F.col("p_partkey")
    home = _pick(DIRS, k % 8)
    rel = F.concat(F.when(home == ".", "").otherwise(F.concat(home, F.lit("/"))), _pick(STEMS, F.floor(k / 8) % 8), _pick(ENDS, F.floor(k / 64) % 8))
    return table(spark, d, "part").select(rel.alias("rel")).distinct()


PATHS = f"""p AS (SELECT DISTINCT CASE WHEN home = '.' THEN '' ELSE home || '/' END || stem || ending AS rel FROM (
  SELECT {_sql_pick(DIRS, 'p_partkey % 8')} AS home, {_sql_pick(STEMS, '(p_partkey // 8) % 8')} AS stem, {_sql_pick(ENDS, '(p_partkey // 64) % 8')} AS ending FROM part))"""
EXT = "CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN lower(regexp_extract(name, '(\\.[^.]+)$', 1)) ELSE '' END"
LANG = f"""n AS (SELECT rel, regexp_extract(rel, '([^/]*)$', 1) AS name, CASE WHEN contains(rel, '/') THEN regexp_extract(rel, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM p),
l AS (SELECT *, CASE {EXT} WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.go' THEN 'Go' WHEN '.rs' THEN 'Rust' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON' END AS language FROM n),
t AS (SELECT *, language NOT IN ('Markdown', 'JSON') AS is_source,
  (name LIKE 'test\\_%.py' ESCAPE '\\' OR name LIKE '%\\_test.py' ESCAPE '\\' OR name = 'conftest.py' OR name LIKE '%.test.js' OR name LIKE '%.test.ts' OR name LIKE '%\\_test.go' ESCAPE '\\')
  OR (language NOT IN ('Markdown', 'JSON') AND list_has_any(string_split(lower(dir), '/'), ['test', 'tests', 'spec', 'specs', '__tests__', 'e2e'])) AS is_test FROM l)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return pt.with_language(paths(spark, d)).withColumn("is_test", pt.is_test(F.col("rel"), F.col("is_source")))


@query(f"WITH {PATHS}, {LANG} SELECT rel, language, is_source, is_test FROM t")
def p1_p6_p7_languages_and_tests(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("rel", "language", "is_source", "is_test")


_GLOBS = ["node_modules", "*.min.js", "docs/", "src/**/*.py", "tests/*/main*", "!src", "/lib/config.[jm]*"]


@query(
    f"""WITH {PATHS} SELECT rel, CASE WHEN list_contains(string_split(rel, '/'), 'node_modules') THEN 'node_modules' WHEN len(list_filter(string_split(rel, '/'), lambda x: x LIKE '%.min.js')) > 0 THEN '*.min.js'
    WHEN rel LIKE 'docs/%' OR rel LIKE '%/docs/%' THEN 'docs/' WHEN rel LIKE 'src/%.py' THEN 'src/**/*.py' WHEN regexp_matches(rel, '^tests/[^/]*/main') THEN 'tests/*/main*'
    WHEN rel LIKE 'lib/config.j%' OR rel LIKE 'lib/config.m%' THEN '/lib/config.[jm]*' END AS reason FROM p"""
)
def p2_p3_p4_exclusion_reason(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return p.select("rel", pt.first_reason(F.col("rel"), _GLOBS).alias("reason"))


@query(f"WITH {PATHS} SELECT rel FROM p WHERE rel LIKE 'src/%' OR rel LIKE '%/src/%' OR rel LIKE '%.md'")
def p5_include_filter(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return p.filter(pt.included(F.col("rel"), ["src", "*.md"]))


@query(f"WITH {PATHS} SELECT rel, starts_with(rel, 'docs') OR starts_with(rel, 'Jenkinsfile') AS ci FROM p")
def p9_prefix_predicate(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return p.select("rel", pt.starts_any(F.col("rel"), ["docs", "Jenkinsfile"]).alias("ci"))


_HOMES = "[dir, dir || '/tests', dir || '/test', dir || '/__tests__', 'tests/' || dir, 'test/' || dir, CASE WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE '.' END || '/tests', 'tests/' || regexp_extract(dir, '([^/]*)$', 1), 'tests']"


@query(
    f"""WITH {PATHS}, {LANG}, s AS (SELECT dir, count(*) AS sources FROM t WHERE is_source AND NOT is_test AND NOT starts_with(dir, 'never') GROUP BY dir HAVING count(*) >= 2), h AS (SELECT DISTINCT dir FROM t WHERE is_test AND dir <> 'tests')
    SELECT dir, sources FROM s WHERE NOT list_has_any({_HOMES}, (SELECT list(dir) FROM h))"""
)
def j9_uncovered_directories(spark: SparkSession, d: str) -> DataFrame:
    """As if there were no common test directory, which would cover everything."""
    f = _tagged(spark, d)
    return pt.uncovered(f.filter(~(F.col("is_test") & (sc.directory(F.col("rel")) == "tests"))))


@query(f"WITH {PATHS} SELECT v.label FROM (VALUES ('a README'), ('a LICENSE'), ('a CONTRIBUTING guide'), ('CODEOWNERS'), ('an .editorconfig'), ('a .gitignore')) AS v(label) WHERE label <> 'a README' OR NOT EXISTS (SELECT 1 FROM p WHERE regexp_matches(rel, '(^|/)README.md$'))")
def rule_missing_files(spark: SparkSession, d: str) -> DataFrame:
    return pt.missing_files(paths(spark, d)).select("label")


# ---- dependencies ---------------------------------------------------------------------------------------------------

ECOSYSTEMS = ["npm", "python", "cargo", "gomod", "maven", "gradle", "bundler", "composer", "pub"]
NAMES = ["left-pad", "Foo_Bar[extra]", "@scope/Widget", "org.x:core", "pytest", "pytest-cov", "vendor/Tool", "serde", "jest-dom", "plain", "zlib"]
GROUPS = ["prod", "dev", "optional", "peer"]


def deps(spark: SparkSession, d: str) -> DataFrame:
    """deps(manifest, ecosystem, name, spec, grp) made from part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = size.cast("string")
    specs = [F.concat(F.lit("^1.2."), n), F.concat(F.lit("==2.0."), n), F.lit(">=1.0,<2.0"), F.concat(F.lit("v1."), n, F.lit(".0")), F.concat(F.lit("1.4."), n), F.lit("latest"), F.concat(F.lit(" ~> 3."), n, F.lit(" ")), F.lit("${prop}"), F.lit("[1.0,2.0)"), F.lit("1.2.3 || 2.0.0")]
    spec = F.get(F.array(*specs), (F.floor(k / 3) % len(specs)).cast("int"))
    return table(spark, d, "part").select(
        F.concat(F.lit("m"), (k % 40).cast("string")).alias("manifest"), _pick(ECOSYSTEMS, size % 9).alias("ecosystem"), _pick(NAMES, k % 11).alias("name"), spec.alias("spec"), _pick(GROUPS, F.floor(k / 11) % 4).alias("grp")
    )


DEPS = f"""d AS (SELECT 'm' || CAST(p_partkey % 40 AS VARCHAR) AS manifest, {_sql_pick(ECOSYSTEMS, 'p_size % 9')} AS ecosystem, {_sql_pick(NAMES, 'p_partkey % 11')} AS name,
  ['^1.2.' || p_size, '==2.0.' || p_size, '>=1.0,<2.0', 'v1.' || p_size || '.0', '1.4.' || p_size, 'latest', ' ~> 3.' || p_size || ' ', '${{prop}}', '[1.0,2.0)', '1.2.3 || 2.0.0'][(p_partkey // 3) % 10 + 1] AS spec,
  {_sql_pick(GROUPS, '(p_partkey // 11) % 4')} AS grp FROM part),
v AS (SELECT *, nullif(CASE ecosystem
  WHEN 'npm' THEN regexp_extract(trim(split_part(regexp_replace(trim(spec), '^[\\^~>=<\\s]*', ''), '||', 1)), '^(\\d+(?:\\.\\d+)*)', 1)
  WHEN 'gomod' THEN regexp_extract(trim(spec), '^v?(\\d[\\w.\\-+]*)', 1)
  WHEN 'maven' THEN CASE WHEN regexp_matches(trim(spec), '^\\$\\{{[^}}]+\\}}$') THEN regexp_extract(trim(spec), '^\\$\\{{([^}}]+)\\}}$', 1) ELSE regexp_extract(trim(spec), '^\\$?\\{{?[\\w.\\-]*\\}}?(\\d[\\w.\\-]*)', 1) END
  WHEN 'gradle' THEN CASE WHEN regexp_matches(spec, '\\+|latest\\.|\\*') THEN '' ELSE rtrim(regexp_extract(spec, '\\d[\\w.\\-+]*'), '.') END
  ELSE regexp_extract(trim(split_part(trim(regexp_replace(trim(split_part(trim(spec), ',', 1)), '^(===|==|>=|<=|~=|!=|>|<|\\^|~|=)', '')), '[', 1)), '^(\\d[\\w.\\-+]*)', 1) END, '') AS version,
  CASE WHEN regexp_matches(trim(spec), '\\|\\|| |&&') AND ecosystem <> 'maven' AND NOT (ecosystem = 'python' AND starts_with(trim(spec), '==')) THEN false
    WHEN ecosystem = 'python' THEN starts_with(trim(spec), '==') WHEN ecosystem = 'npm' THEN regexp_matches(trim(spec), '^\\d+\\.\\d+\\.\\d+(?:-[0-9A-Za-z.\\-]+)?$')
    WHEN ecosystem = 'gomod' THEN regexp_matches(trim(spec), '^v\\d+\\.\\d+\\.\\d+') WHEN ecosystem = 'bundler' THEN regexp_matches(trim(spec), '^\\d+(?:\\.\\d+)*$')
    WHEN ecosystem = 'gradle' THEN NOT regexp_matches(spec, 'latest|\\[|\\+') WHEN ecosystem = 'maven' THEN NOT contains(spec, '${{') WHEN ecosystem IN ('composer', 'pub') THEN regexp_matches(trim(spec), '^\\d')
    ELSE regexp_matches(trim(spec), '^\\d+(?:\\.\\d+)+') END AS pinned,
  CASE WHEN ecosystem = 'npm' THEN lower(split_part(name, '/', -1)) WHEN ecosystem IN ('composer', 'pub') THEN lower(name) WHEN ecosystem = 'maven' THEN split_part(name, ':', -1)
    WHEN ecosystem = 'python' THEN regexp_replace(replace(lower(name), '_', '-'), '\\[.*\\]', '') ELSE name END AS package,
  CASE WHEN ecosystem = 'python' THEN regexp_replace(lower(regexp_replace(name, '\\[.*?\\]', '')), '[-_.]+', '-', 'g') WHEN ecosystem = 'npm' THEN lower(split_part(name, '/', -1)) ELSE name END AS asked,
  map {{'python': 'PyPI', 'npm': 'npm', 'cargo': 'crates.io', 'gomod': 'Go', 'maven': 'Maven', 'gradle': 'Maven', 'composer': 'Packagist', 'bundler': 'RubyGems', 'pub': 'Pub'}}[ecosystem] AS database FROM d)"""


@query(f"WITH {DEPS} SELECT DISTINCT ecosystem, spec, version, pinned FROM v")
def f7_f8_versions_and_pins(spark: SparkSession, d: str) -> DataFrame:
    s, e = F.col("spec"), F.col("ecosystem")
    return deps(spark, d).select("ecosystem", "spec", sc.extract_version(s, e).alias("version"), sc.is_pinned(s, e).alias("pinned")).distinct()


@query(f"WITH {DEPS} SELECT DISTINCT version, array_to_string(list_slice(regexp_extract_all(split_part(version, '-', 1), '\\d+'), 1, 4), '.') AS parts FROM v WHERE version IS NOT NULL")
def f9_version_tuple(spark: SparkSession, d: str) -> DataFrame:
    v = deps(spark, d).select(sc.extract_version(F.col("spec"), F.col("ecosystem")).alias("version")).filter("version is not null").distinct()
    return v.select("version", F.array_join(F.transform(sc.version_tuple(F.col("version")), lambda x: x.cast("string")), ".").alias("parts"))


@query(f"WITH {DEPS} SELECT ecosystem, count(*) FILTER (grp = 'prod' AND NOT pinned) AS unpinned, count(*) AS total, round(count(*) FILTER (grp = 'prod' AND NOT pinned) / count(*)::DOUBLE, 9) AS share, "
       "CASE WHEN count(*) FILTER (grp = 'prod' AND NOT pinned) / count(*)::DOUBLE >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM v GROUP BY ecosystem HAVING count(*) FILTER (grp = 'prod' AND NOT pinned) > 0")
def a14_unpinned_share(spark: SparkSession, d: str) -> DataFrame:
    return dp.unpinned(deps(spark, d)).withColumn("share", F.round("share", 9))


@query(f"WITH {DEPS} SELECT package, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, count(DISTINCT manifest) AS manifests FROM v WHERE version IS NOT NULL GROUP BY package HAVING count(DISTINCT version) >= 2 AND count(DISTINCT manifest) >= 2")
def a15_f10_version_skew(spark: SparkSession, d: str) -> DataFrame:
    return dp.version_skew(deps(spark, d)).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {DEPS} SELECT manifest, name, count(*) AS n, count(DISTINCT spec) AS specs FROM v GROUP BY manifest, name HAVING count(*) >= 2 AND count(DISTINCT spec) >= 2")
def a16_declared_twice(spark: SparkSession, d: str) -> DataFrame:
    return dp.declared_twice(deps(spark, d))


@query(f"WITH {DEPS} SELECT count(*) AS total, count(*) FILTER (grp = 'prod') AS prod, count(*) FILTER (grp = 'dev') AS dev, count(*) FILTER (grp = 'optional') AS optional FROM v")
def a20_dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    return dp.counts(deps(spark, d))


@query(f"WITH {DEPS} SELECT manifest, name, count(*) AS n FROM v WHERE grp = 'prod' AND (name IN ('pytest', 'pytest-cov') OR starts_with(name, 'jest-')) GROUP BY manifest, name")
def p11_test_only_in_production(spark: SparkSession, d: str) -> DataFrame:
    return dp.test_only_in_production(deps(spark, d)).groupBy("manifest", "name").agg(F.count("*").alias("n"))


def _locks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    locks = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("lock"), F.col("s_suppkey").cast("string")).alias("path"), _pick(ECOSYSTEMS, F.col("s_suppkey") % 7).alias("ecosystem"), (F.col("s_suppkey") * 1000).alias("mtime"))
    manifests = s.select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("path"), _pick(ECOSYSTEMS, F.col("s_suppkey") % 9).alias("ecosystem"), (F.col("s_suppkey") * 2500).alias("mtime"))
    touched = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") * 5000).alias("last_ts"))
    return manifests, locks, touched


_LOCKS = f"""k AS (SELECT 'lock' || s_suppkey AS path, {_sql_pick(ECOSYSTEMS, 's_suppkey % 7')} AS ecosystem, s_suppkey * 1000 AS mtime FROM supplier WHERE s_suppkey % 3 = 0),
o AS (SELECT ecosystem, min(path) AS lock, arg_min(mtime, path) AS lock_mtime FROM k GROUP BY ecosystem),
m AS (SELECT 'm' || s_suppkey AS manifest, {_sql_pick(ECOSYSTEMS, 's_suppkey % 9')} AS ecosystem, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 5000 ELSE s_suppkey * 2500 END AS t FROM supplier)"""


@query(f"WITH {_LOCKS} SELECT manifest, ecosystem, lock, coalesce(t - lock_mtime > 86400, false) AS stale FROM m LEFT JOIN o USING (ecosystem)")
def j5_j6_lock_state(spark: SparkSession, d: str) -> DataFrame:
    return dp.lock_state(*_locks(spark, d))


@query(f"WITH {DEPS}, {_LOCKS} SELECT DISTINCT d.ecosystem FROM d WHERE grp = 'prod' AND d.ecosystem NOT IN (SELECT ecosystem FROM k)")
def rule_missing_lock(spark: SparkSession, d: str) -> DataFrame:
    return dp.without_lock(deps(spark, d), _locks(spark, d)[1])


# ---- advisories -----------------------------------------------------------------------------------------------------

_KEY = """'["' || database || '","' || asked || '","' || version || '"]'"""


@query(f"WITH {DEPS} SELECT name, ecosystem, count(*) AS n, min({_KEY}) AS first_key FROM v WHERE grp IN ('prod', 'optional') AND version IS NOT NULL GROUP BY name, ecosystem")
def p10_f11_advisory_keys(spark: SparkSession, d: str) -> DataFrame:
    return dp.queryable(deps(spark, d)).groupBy("name", "ecosystem").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    wanted = dp.queryable(deps(spark, d)).select("key").distinct()
    return wanted.filter(F.length("key") % 2 == 0).withColumn("fetched_at", F.when(F.length("key") % 4 == 0, 900_000).otherwise(990_000))


@query(f"WITH {DEPS} SELECT DISTINCT {_KEY} AS key FROM v WHERE grp IN ('prod', 'optional') AND version IS NOT NULL AND (length({_KEY}) % 2 <> 0 OR length({_KEY}) % 4 = 0)")
def j7_s12_pending_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a fresh row in the cache; rows older than a day do not count."""
    return dp.pending_keys(dp.queryable(deps(spark, d)), _cache(spark, d), now=1_000_000)


METRICS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _vector():
    k = F.col("p_partkey") * 7 + F.col("p_size")
    parts, div = [F.lit("CVSS:3.1")], 1
    for name, letters in METRICS.items():
        parts.append(F.concat(F.lit(name + ":"), _pick(list(letters), F.floor(k / div) % len(letters))))
        div *= len(letters)
    return F.concat_ws("/", *parts)


def _sql_vector() -> str:
    k, parts, div = "(p_partkey * 7 + p_size)", ["'CVSS:3.1'"], 1
    for name, letters in METRICS.items():
        parts.append(f"'{name}:' || " + _sql_pick(list(letters), f"({k} // {div}) % {len(letters)}"))
        div *= len(letters)
    return " || '/' || ".join(parts)


def _sql_metric(name: str, table_: dict, other: str = "NULL") -> str:
    return "CASE regexp_extract(vector, '/" + name + ":([^/]*)', 1) " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table_.items()) + f" ELSE {other} END"


_CVSS = f"""c AS (SELECT DISTINCT {_sql_vector()} AS vector FROM part),
m AS (SELECT vector, contains(vector, '/S:C') AS changed, {_sql_metric('AV', sc.CVSS['AV'])} AS av, {_sql_metric('AC', sc.CVSS['AC'])} AS ac, {_sql_metric('UI', sc.CVSS['UI'])} AS ui,
  CASE WHEN contains(vector, '/S:C') THEN {_sql_metric('PR', sc.CVSS['PR_changed'])} ELSE {_sql_metric('PR', sc.CVSS['PR_kept'])} END AS pr,
  1 - (1 - {_sql_metric('C', sc.CVSS['CIA'])}) * (1 - {_sql_metric('I', sc.CVSS['CIA'])}) * (1 - {_sql_metric('A', sc.CVSS['CIA'])}) AS iss FROM c),
i AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact FROM m),
r AS (SELECT vector, impact, CAST(round_even(least((impact + 8.22::DOUBLE * av * ac * pr * ui) * CASE WHEN changed THEN 1.08::DOUBLE ELSE 1 END, 10) * 100000, 0) AS BIGINT) AS scaled FROM i),
s AS (SELECT vector, CASE WHEN impact <= 0 THEN 0.0::DOUBLE WHEN scaled % 10000 = 0 THEN scaled / 100000.0::DOUBLE ELSE (scaled // 10000 + 1) / 10.0::DOUBLE END AS score FROM r)"""


@query(f"WITH {_CVSS} SELECT vector, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS severity FROM s")
def f12_cvss_base_score(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select(_vector().alias("vector")).distinct().withColumn("score", sc.cvss_base(F.col("vector")))
    return v.withColumn("severity", sc.score_severity(F.col("score")))


@query(
    f"""WITH {DEPS}, {_CVSS}, adv AS (SELECT 'A' || row_number() OVER (ORDER BY vector) AS id, CASE WHEN score >= 9 THEN 4 WHEN score >= 7 THEN 3 WHEN score >= 4 THEN 2 ELSE 1 END AS rank, row_number() OVER (ORDER BY vector) AS n FROM s),
    w AS (SELECT name, manifest, version, length({_KEY}) AS k FROM v WHERE grp IN ('prod', 'optional') AND version IS NOT NULL)
    SELECT name, manifest, version, CASE greatest(2, max(rank)) WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity, count(DISTINCT id) AS advisories
    FROM w JOIN adv ON n % 40 = k % 40 GROUP BY name, manifest, version"""
)
def j8_a19_vulnerable_dependencies(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    scored = f12_cvss_base_score(spark, d).withColumn("n", F.row_number().over(Window.orderBy("vector"))).withColumn("id", F.concat(F.lit("A"), F.col("n").cast("string")))
    wanted = dp.queryable(deps(spark, d))
    keys = wanted.select("key").distinct().withColumn("k", F.length("key") % 40)
    matches = keys.join(scored.select("id", (F.col("n") % 40).alias("k")), "k").select("key", "id")
    return dp.vulnerable(wanted, matches, scored).withColumn("advisories", F.size("advisories").cast("bigint"))


@query("SELECT c_custkey, CASE WHEN length(l) <= 2 THEN left(l, 1) || '*' ELSE left(l, 1) || repeat('*', length(l) - 2) || right(l, 1) END || '@example.org' AS masked FROM (SELECT c_custkey, lower(replace(c_name, '#', '')) AS l FROM customer)")
def f6_masked_email(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", sc.mask_email(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.org"))).alias("masked"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE ELSE round(100.0 * p_size / (p_size % 4), 9) END AS pct, CAST(CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE -1 END AS BIGINT) AS cell FROM part")
def f1_s6_percent_and_cells(spark: SparkSession, d: str) -> DataFrame:
    p, size = table(spark, d, "part"), F.col("p_size")
    cell = F.when(size % 3 == 0, "-").when(size % 3 == 1, size.cast("string")).otherwise("x1")
    return p.select("p_partkey", F.round(sc.percent(size.cast("double"), (size % 4).cast("double")), 9).alias("pct"), F.coalesce(sc.numstat_cell(cell), F.lit(-1)).alias("cell"))
