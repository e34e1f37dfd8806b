"""The rule catalogue and the scales that findings are judged by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ranks, penalty points, confidence weights, dimensions in order of report.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_PENALTY = {"critical": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0, "info": 0.3}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.8, "heuristic": 0.5}
DIMENSIONS = ("complexity", "hotspots", "tests", "hygiene", "deps")


@dataclass(frozen=True)
class RuleEntry:
    id: str
    severity: str
    title: str
    remedy: str

    @property
    def dimension(self) -> str:
        return self.id.split(".")[0]


RULES = tuple(
    RuleEntry(*row)
    for row in (
        # Ids and severities.
        ("complexity.large_file", "medium", "File has grown too long", "Split it along its responsibilities."),
        ("complexity.deep_nesting", "medium", "Control flow nests too deeply", "Return early or extract inner blocks."),
        ("complexity.long_function", "medium", "Function is too long", "Extract steps into functions with names."),
        ("complexity.complex_function", "medium", "Function branches too much", "Separate the cases it handles."),
        ("complexity.many_parameters", "low", "Function takes many parameters", "Group what belongs together in one object."),
        ("complexity.long_lines", "low", "Many lines are too long", "Wrap lines, or let a formatter do so."),
        ("complexity.duplication", "medium", "Block is duplicated", "Move the shared block to one place."),
        ("complexity.parse_error", "info", "Source does not parse", "Fix the syntax error or exclude the file."),
        ("complexity.empty_file", "info", "Source file holds nothing", "Remove it, or say why it exists."),
        ("hotspots.high_churn_complex", "high", "Complex file changes often", "Simplify what is changed most, first."),
        ("hotspots.sole_owner", "medium", "One author alone knows a hotspot", "Review and pair on it."),
        ("hotspots.history_unavailable", "info", "No file changes in the history", "Fetch the full history."),
        ("tests.low_ratio", "high", "Little test code for the source there is", "Cover the riskiest modules first."),
        ("tests.no_counterpart", "medium", "Directory without tests", "Add a test module for it."),
        ("tests.low_assertion_density", "medium", "Tests assert little", "Assert on results, not on completion."),
        ("tests.skipped_leftover", "high", "Skipped or focused tests were left behind", "Run them again or delete them."),
        ("tests.flaky_smell", "medium", "Tests depend on time, chance or ports", "Inject clocks, seeds and ports."),
        ("tests.stale", "medium", "Source changed long after its test", "Bring the test up to date."),
        ("tests.large_test_file", "low", "Test file has grown too long", "Split it by behaviour."),
        ("tests.empty_test", "medium", "Test without a body", "Write it or remove it."),
        ("tests.no_framework", "low", "No test framework recognised", "Declare the framework that runs the tests."),
        ("tests.history_unavailable", "info", "Staleness of tests is unknown", "Analyse a clone with its history."),
        ("hygiene.bus_factor", "high", "Few authors carry the work", "Spread knowledge by review and rotation."),
        ("hygiene.single_author", "high", "One author wrote everything", "Bring in a second maintainer."),
        ("hygiene.dormant", "medium", "No recent commits", "State whether it is still maintained."),
        ("hygiene.long_dry_spell", "low", "Long pause between commits", "Keep maintenance small and regular."),
        ("hygiene.conventional_commits", "low", "Few commit subjects follow the convention", "Agree on a form and check it."),
        ("hygiene.merge_ratio", "info", "Unusual share of merge commits", "Look at how branches are integrated."),
        ("hygiene.long_lived_branches", "medium", "Branches older than the limit", "Merge or delete them."),
        ("hygiene.missing_file", "low", "Customary file is missing", "Add it."),
        ("hygiene.large_blob", "medium", "Large file is tracked", "Keep it out of the repository."),
        ("hygiene.no_readme", "medium", "No substantive README", "Say what it is and how to run it."),
        ("hygiene.no_ci", "medium", "No continuous integration", "Run the tests on every change."),
        ("hygiene.history_unavailable", "info", "No history to judge", "Analyse a clone with its history."),
        ("deps.vulnerability", "critical", "Dependency has a known vulnerability", "Upgrade to a fixed version."),
        ("deps.stale_lock", "medium", "Lock file is older than its manifest", "Lock again."),
        ("deps.missing_lock", "medium", "No lock file", "Commit one."),
        ("deps.unpinned_prod", "medium", "Production dependencies float", "Pin them or lock them."),
        ("deps.version_skew", "medium", "One package at several versions", "Agree on one."),
        ("deps.duplicate_declaration", "low", "Package declared twice", "Keep one declaration."),
        ("deps.dev_in_prod", "low", "Test package among production dependencies", "Move it to the development group."),
        ("deps.old_release", "low", "Release is old", "Upgrade."),
        ("deps.parse_error", "low", "Manifest does not parse", "Fix it."),
        ("deps.uncatalogued", "info", "Dependency of an unknown kind", "None."),
    )
)


def rules_frame(spark: SparkSession) -> DataFrame:
    """rules(id, dimension, severity, title, remedy): 44 rows, small enough to broadcast anywhere."""
    return spark.createDataFrame([(r.id, r.dimension, r.severity, r.title, r.remedy) for r in RULES], "id string, dimension string, severity string, title string, remedy string")


def mapped(col: Column | str, values: dict, default=None) -> Column:
    """A lookup in a small fixed table, as a CASE expression."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(default)
    for key, value in reversed(list(values.items())):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def severity_rank(col: Column | str) -> Column:
    return mapped(col, SEVERITY_RANK).cast("int")


def penalty(severity: Column | str, confidence: Column | str) -> Column:
    """Points a finding costs: severity times confidence, in exact hundredths, so that sums do not depend on their order."""
    return (mapped(severity, SEVERITY_PENALTY) * mapped(confidence, CONFIDENCE_WEIGHT)).cast("decimal(6,2)")
