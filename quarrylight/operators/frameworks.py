"""Which test frameworks a tree uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dependency names, or beginnings of them, and the framework that they reveal.
HINTS = {
    "pytest": "pytest", "unittest2": "unittest", "nose": "nose", "hypothesis": "hypothesis", "jest": "jest", "vitest": "vitest", "mocha": "mocha", "jasmine": "jasmine", "ava": "ava",
    "tap": "node-tap", "@playwright/test": "playwright", "cypress": "cypress", "testing-library": "testing-library", "junit": "JUnit", "junit-jupiter": "JUnit 5", "testng": "TestNG",
    "mockito": "Mockito", "rspec": "RSpec", "minitest": "Minitest", "cucumber": "Cucumber", "googletest": "GoogleTest", "catch2": "Catch2", "ginkgo": "Ginkgo", "vitest-": "Vitest",
}


def frameworks(deps: DataFrame, tests: DataFrame) -> DataFrame:
    """(framework): by names of dependencies (equal to a hint or beginning with it), or by imports of unittest in tests (text)."""
    name = F.lower(F.element_at(F.split("name", "[/:]"), -1))
    hit = F.array_compact(F.array(*[F.when((F.col("name") == h) | name.startswith(h), F.lit(f)) for h, f in HINTS.items()]))
    declared = deps.select(F.explode(hit).alias("framework"))
    imported = tests.filter(F.col("text").rlike(r"(?m)^\s*(import unittest\b|from unittest\b)")).select(F.lit("unittest").alias("framework"))
    return declared.unionByName(imported).distinct()
