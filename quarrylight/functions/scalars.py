"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import mapped
from ..config import DEFAULTS


def percent(n: Column, d: Column) -> Column:
    """100 * n / d, 0 where d is not positive."""
    return F.when(d > 0, 100.0 * n / d).otherwise(F.lit(0.0))


def grade(score: Column, bands: dict[str, float] = DEFAULTS["grade_bands"]) -> Column:
    """The letter of the highest band reached; null stays null, as it means not measured."""
    out = F.lit("F")
    for letter, least in sorted(bands.items(), key=lambda x: x[1]):
        out = F.when(score >= least, letter).otherwise(out)
    return F.when(score.isNotNull(), out)


def dimension_score(points: Column, budget: Column) -> Column:
    """100 less the share of the budget that penalties use up."""
    return F.when(budget <= 0, 100.0).otherwise(100.0 * (1 - F.least(F.lit(1.0), points / F.when(budget > 0, budget))))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024.0**power, F.format_string(f"%.1f {unit}", n / (1024.0**power))).otherwise(out)
    return out


def human_days(days: Column) -> Column:
    return (
        F.when(days < 1, "today").when(days < 60, F.format_string("%dd", days.cast("bigint")))
        .when(days < 730, F.format_string("%dmo", (days / 30).cast("bigint"))).otherwise(F.format_string("%.1fy", days / 365.0))
    )


def mask_email(address: Column) -> Column:
    """The first and last character of the local part, stars between; of one or two characters the first and a star."""
    local, domain = F.split_part(address, F.lit("@"), F.lit(1)), F.split_part(address, F.lit("@"), F.lit(2))
    n = F.length(local)
    masked = F.when(n <= 2, F.concat(F.substring(local, 1, 1), F.lit("*"))).otherwise(
        F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(local, n, F.lit(1)))
    )
    return F.when(F.instr(address, "@") > 0, F.concat(masked, F.lit("@"), domain)).otherwise(address)


def directory(rel: Column) -> Column:
    return F.when(F.instr(rel, "/") > 0, F.regexp_extract(rel, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def file_name(rel: Column) -> Column:
    return F.regexp_extract(rel, "([^/]*)$", 1)


# Conventional Commits types and ticket references.
CONVENTIONAL = r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]*\))?!?:\s+\S"
TICKET = r"(?:[A-Z]{2,}-\d+|#\d+|gh-\d+)"


def numstat_cell(cell: Column) -> Column:
    """A count of lines; "-" (binary) is 0, anything else but digits null."""
    return F.when(cell == "-", F.lit(0)).when(cell.rlike("^[0-9]+$"), cell.cast("bigint"))


# ---- versions -------------------------------------------------------------------------------------------------------


def extract_version(spec: Column, ecosystem: Column) -> Column:
    """A comparable version out of a requirement, or null."""
    text = F.trim(spec)
    first = lambda c, pattern, group=1: F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    npm = first(F.trim(F.split_part(F.regexp_replace(text, r"^[\^~>=<\s]*", ""), F.lit("||"), F.lit(1))), r"^(\d+(?:\.\d+)*)")
    gomod = first(text, r"^v?(\d[\w.\-+]*)")
    maven = F.coalesce(first(text, r"^\$\{([^}]+)\}$"), first(text, r"^\$?\{?[\w.\-]*\}?(\d[\w.\-]*)"))
    gradle = F.when(~text.rlike(r"\+|latest\.|\*"), F.nullif(F.regexp_replace(F.regexp_extract(text, r"\d[\w.\-+]*", 0), r"\.+$", ""), F.lit("")))
    plain = F.trim(F.split_part(F.trim(F.regexp_replace(text, r";\s*(python_version|sys_platform|platform_system|os_name)[\s\S]*", "")), F.lit(","), F.lit(1)))
    plain = F.trim(F.regexp_replace(plain, r"^(===|==|>=|<=|~=|!=|>|<|\^|~|=)", ""))
    plain = first(F.trim(F.split_part(plain, F.lit("["), F.lit(1))), r"^(\d[\w.\-+]*)")
    found = F.when(ecosystem == "npm", npm).when(ecosystem == "gomod", gomod).when(ecosystem == "maven", maven).when(ecosystem == "gradle", gradle).otherwise(plain)
    return F.when(F.length(spec) > 0, found)


def is_pinned(spec: Column, ecosystem: Column) -> Column:
    """Whether a requirement admits one version only."""
    text = F.trim(spec)
    compound = text.rlike(r"\|\|| |&&") & (ecosystem != "maven") & ~((ecosystem == "python") & text.startswith("=="))
    exact = (
        F.when(ecosystem == "python", F.trim(F.split_part(text, F.lit(";"), F.lit(1))).startswith("=="))
        .when(ecosystem == "npm", text.rlike(r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.\-]+)?$"))
        .when(ecosystem == "gomod", text.rlike(r"^v\d+\.\d+\.\d+"))
        .when(ecosystem == "bundler", text.rlike(r"^\d+(?:\.\d+)*$"))
        .when(ecosystem == "gradle", ~text.rlike(r"latest|\[|\+"))
        .when(ecosystem == "maven", ~text.contains("${"))
        .when(ecosystem.isin("composer", "pub"), text.rlike(r"^\d"))
        .otherwise(text.rlike(r"^\d+(?:\.\d+)+"))
    )
    return F.coalesce(F.when((text == "") | compound, F.lit(False)).otherwise(exact), F.lit(False))


def version_tuple(version: Column) -> Column:
    """Up to four numbers of the part before a hyphen; arrays compare as versions do."""
    digits = F.regexp_extract_all(F.split_part(version, F.lit("-"), F.lit(1)), F.lit(r"\d+"), F.lit(0))
    return F.coalesce(F.slice(F.transform(digits, lambda d: d.cast("bigint")), 1, 4), F.array().cast("array<bigint>"))


def skew_key(name: Column, ecosystem: Column) -> Column:
    """A package's name in the form in which one package's declarations agree."""
    return (
        F.when(ecosystem == "npm", F.lower(F.element_at(F.split(name, "/"), -1)))
        .when(ecosystem.isin("composer", "pub"), F.lower(name))
        .when(ecosystem == "maven", F.element_at(F.split(name, ":"), -1))
        .when(ecosystem == "python", F.regexp_replace(F.replace(F.lower(name), F.lit("_"), F.lit("-")), r"\[.*\]", ""))
        .otherwise(name)
    )


# Packages that only tests need.
TEST_ONLY = (
    "pytest pytest-cov pytest-mock mock faker factory-boy freezegun hypothesis nose nose2 tox coverage unittest2 responses vcrpy jest vitest mocha "
    "chai sinon supertest cypress enzyme @types/jest @types/mocha ts-jest karma jasmine-core nock junit testng mockito junit-jupiter assertj "
    "rest-assured rspec rspec-rails capybara factory_bot shoulda-matchers vcr testcontainers phpunit phpunit/phpunit mockery codeception cucumber "
    "ginkgo gomega testify httptest quicktest gtest gmock catch2 conan-test xunit NUnit AwesomeAssertions"
).split()


def is_test_only(name: Column) -> Column:
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return base.isin(TEST_ONLY) | base.rlike("^(pytest-|jest-|ts-jest)")


# ---- advisories -----------------------------------------------------------------------------------------------------

# The advisory database's ecosystem names; CVSS v3 metric weights.
ADVISORY_ECOSYSTEM = {
    "python": "PyPI", "npm": "npm", "cargo": "crates.io", "gomod": "Go", "maven": "Maven", "gradle": "Maven", "composer": "Packagist", "bundler": "RubyGems", "pub": "Pub",
}
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR_kept": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_changed": {"N": 0.85, "L": 0.68, "H": 0.50},
}


def advisory_name(name: Column, ecosystem: Column) -> Column:
    python = F.regexp_replace(F.lower(F.regexp_replace(name, r"\[.*?\]", "")), r"[-_.]+", "-")
    return F.when(ecosystem == "python", python).when(ecosystem == "npm", F.lower(F.element_at(F.split(name, "/"), -1))).otherwise(name)


def advisory_key(name: Column, ecosystem: Column, version: Column) -> Column:
    """A lookup key as a JSON array, for names that hold separators."""
    return F.to_json(F.array(mapped(ecosystem, ADVISORY_ECOSYSTEM), advisory_name(name, ecosystem), version))


def cvss_round_up(value: Column) -> Column:
    """The specification's Roundup: to one decimal upwards, after rounding at the fifth."""
    scaled = F.bround(value * 100000).cast("bigint")
    return F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)


def cvss_base(vector: Column) -> Column:
    """The CVSS v3.0/3.1 base score of a vector string; null if it is no such vector."""
    metric = lambda name: F.nullif(F.regexp_extract(F.trim(vector), rf"(?:^|/){name}:([^/]*)", 1), F.lit(""))
    scope = metric("S")
    changed = scope == "C"
    privileges = F.when(changed, mapped(metric("PR"), CVSS["PR_changed"])).otherwise(mapped(metric("PR"), CVSS["PR_kept"]))
    harm = [mapped(metric(m), CVSS["CIA"]) for m in ("C", "I", "A")]
    iss = 1 - (1 - harm[0]) * (1 - harm[1]) * (1 - harm[2])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    ease = 8.22 * mapped(metric("AV"), CVSS["AV"]) * mapped(metric("AC"), CVSS["AC"]) * privileges * mapped(metric("UI"), CVSS["UI"])
    total = (impact + ease) * F.when(changed, 1.08).otherwise(1.0)
    score = F.when(impact <= 0, 0.0).otherwise(cvss_round_up(F.least(total, F.lit(10.0))))
    usable = metric("CVSS").startswith("3.") & scope.isNotNull() & ease.isNotNull() & impact.isNotNull()
    return F.when(usable, score)


def score_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low")
