"""Operators over paths: globs, languages, kinds of files, counterparts of tests."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import directory, file_name

# Extensions by language; the last group is not source.
LANGUAGES = {
    "Python": ".py .pyi", "TypeScript": ".ts .tsx .mts .cts", "JavaScript": ".js .jsx .mjs .cjs", "Go": ".go", "Rust": ".rs", "Java": ".java", "Kotlin": ".kt .kts", "C#": ".cs",
    "C": ".c .h", "C++": ".cpp .cc .cxx .hpp .hh .hxx", "Ruby": ".rb", "PHP": ".php", "Swift": ".swift", "Scala": ".scala", "Shell": ".sh .bash .zsh", "PowerShell": ".ps1 .psm1",
    "SQL": ".sql", "Elixir": ".ex .exs", "Erlang": ".erl", "Haskell": ".hs", "Lua": ".lua", "R": ".r", "Dart": ".dart", "Zig": ".zig", "Vue": ".vue", "Svelte": ".svelte",
    "Make": ".mk", "CMake": ".cmake", "Terraform": ".tf .tfvars",
    "Markdown": ".md .markdown", "YAML": ".yaml .yml", "JSON": ".json", "TOML": ".toml", "Dockerfile": ".dockerfile", "Text": ".txt .rst .adoc", "CSV": ".csv", "Lockfile": ".lock",
}
NOT_SOURCE = "Markdown YAML JSON TOML Dockerfile Text CSV Lockfile".split()
NAMED = {
    "Makefile": "Make", "Dockerfile": "Dockerfile", "Jenkinsfile": "Scala", "Rakefile": "Ruby", "Gemfile": "Ruby", "Gemfile.lock": "Lockfile", "Pipfile": "TOML", "Pipfile.lock": "JSON",
    "go.mod": "TOML", "go.sum": "Text", "Cargo.toml": "TOML", "Cargo.lock": "TOML", "CMakeLists.txt": "CMake", ".gitignore": "Text", ".dockerignore": "Text", ".editorconfig": "Text",
}
# The signs that open a line comment and the pairs that enclose a block comment, by language; others are as C.
LINE_COMMENTS = {
    "Python": ["#"], "Ruby": ["#"], "PHP": ["//", "#"], "Shell": ["#"], "PowerShell": ["#"], "SQL": ["--"], "Elixir": ["#"], "Erlang": ["%"], "Haskell": ["--"], "Lua": ["--"], "R": ["#"],
    "Make": ["#"], "CMake": ["#"], "Terraform": ["#"], "Markdown": ["#"], "YAML": ["#"], "TOML": ["#"], "Dockerfile": ["#"], "Text": ["#"],
}
BLOCK_COMMENTS = {
    "Python": [], "Ruby": [("=begin", "=end")], "Shell": [], "PowerShell": [("<#", "#>")], "Elixir": [], "Erlang": [], "Haskell": [("{-", "-}")], "Lua": [("--[[", "]]")], "R": [], "Make": [], "CMake": [],
    "Markdown": [], "YAML": [], "JSON": [], "TOML": [], "Dockerfile": [], "Text": [],
}
C_LIKE = ["//"], [("/*", "*/")]
LOCKFILES = {
    "package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "bun.lockb": "npm", "poetry.lock": "python", "uv.lock": "python",
    "Pipfile.lock": "python", "requirements.lock": "python", "pylock.toml": "python", "pylock.json": "python", "Cargo.lock": "cargo", "go.sum": "gomod", "Gemfile.lock": "bundler",
    "composer.lock": "composer", "pubspec.lock": "pub", "gradle.lockfile": "gradle", "mix.lock": "hex",
}
MANIFESTS = {
    "package.json": "npm", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "Pipfile": "python", "go.mod": "gomod", "Cargo.toml": "cargo",
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "Gemfile": "bundler", "composer.json": "composer", "mix.exs": "hex", "pubspec.yaml": "pub", "Package.swift": "spm",
    "packages.config": "nuget",
}
TEST_NAMES = (
    "test_*.py *_test.py conftest.py *.test.js *.test.jsx *.test.ts *.test.tsx *.spec.js *.spec.jsx *.spec.ts *.spec.tsx *_test.go *Test.java *Tests.java *Spec.java *_spec.rb spec_*.rb "
    "*_test.dart *_test.exs *_test.ex *Tests.cs *Test.cs"
).split()
TEST_DIRECTORIES = ["test", "tests", "spec", "specs", "__tests__", "e2e"]
CI_FILES = (
    ".github/workflows .gitlab-ci.yml .circleci azure-pipelines.yml Jenkinsfile .travis.yml appveyor.yml .drone.yml bitbucket-pipelines.yml .buildkite buildkite.yml Taskfile.yml justfile"
).split()
HOOK_FILES = [".pre-commit-config.yaml", ".pre-commit-config.yml", ".husky"]
BINARY_EXTENSIONS = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .avif .pdf .zip .tar .gz .bz2 .xz .7z .rar .jar .war .exe .dll .so .dylib .a .lib .o .obj .class .pyc .pyo .pyd .wasm .node .bin .dat .db "
    ".sqlite .sqlite3 .woff .woff2 .ttf .otf .eot .mp3 .mp4 .wav .avi .mov .mkv .webm .psd .ai .sketch .ttc .pack .idx"
).split()
# Customary files, what a missing one costs and by which rule.
CUSTOMARY = (
    ("a README", ["README.md", "README.rst", "README", "readme.md"], "medium", "hygiene.no_readme"),
    ("a LICENSE", ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING"], "medium", "hygiene.missing_file"),
    ("a CONTRIBUTING guide", ["CONTRIBUTING.md", "CONTRIBUTING", "CONTRIBUTING.rst"], "low", "hygiene.missing_file"),
    ("CODEOWNERS", ["CODEOWNERS"], "low", "hygiene.missing_file"),
    ("an .editorconfig", [".editorconfig"], "low", "hygiene.missing_file"),
    ("a .gitignore", [".gitignore"], "low", "hygiene.missing_file"),
)


def glob_regex(pattern: str) -> str:
    """An anchored expression: * stays in a component, ** crosses them, ? is one character, [..] a class."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def path_matches(rel: Column, pattern: str) -> Column:
    """Whether a glob covers a path: without a slash any component, ending in one directories only, else the whole path or an
    ancestor; a negated pattern matches nothing."""
    if pattern.startswith("!"):
        return F.lit(False)
    only_directories = pattern.endswith("/")
    body = pattern.rstrip("/").lstrip("/") if pattern.strip("/") else pattern
    inner = glob_regex(body)[1:-1]
    below = "/" if only_directories else "(?:/|$)"
    if "/" in pattern.strip("/"):
        return rel.rlike(f"^{inner}{below}")
    return rel.rlike(f"(?:^|/){inner}{below}")


def first_reason(rel: Column, patterns: list[str]) -> Column:
    """The first pattern, in order, that covers a path, or null."""
    return F.coalesce(*[F.when(path_matches(rel, p), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def included(rel: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that covers a path includes it; everything is included if there are none."""
    if not patterns:
        return F.lit(True)
    return F.coalesce(*[F.when(path_matches(rel, p), F.lit(not p.startswith("!"))) for p in reversed(patterns)], F.lit(False))


def language_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(names, extensions): two small lookup tables."""
    by_extension = [(e, lang) for lang, extensions in LANGUAGES.items() for e in extensions.split()]
    return spark.createDataFrame(list(NAMED.items()), "name string, by_name string"), spark.createDataFrame(by_extension, "ext string, by_ext string")


def extension(name: Column) -> Column:
    """The lower-cased extension with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def with_language(files: DataFrame) -> DataFrame:
    """files (rel, ..) plus name, ext, language and is_source."""
    names, extensions = language_frames(files.sparkSession)
    rows = files.withColumn("name", file_name(F.col("rel"))).withColumn("ext", extension(F.col("name")))
    rows = rows.join(F.broadcast(names), "name", "left").join(F.broadcast(extensions), "ext", "left")  # fixed tables of a few dozen rows
    special = F.when(F.col("name").startswith("Dockerfile"), "Dockerfile").when(F.col("name").startswith("Makefile"), "Make").when(F.col("name").isin(list(LOCKFILES)), "Lockfile")
    rows = rows.withColumn("language", F.coalesce("by_name", special, "by_ext")).drop("by_name", "by_ext")
    return rows.withColumn("is_source", F.coalesce(F.col("language").isNotNull() & ~F.col("language").isin(NOT_SOURCE), F.lit(False)))


TEST_NAME = "|".join(fnmatch.translate(p).removeprefix("(?s:").replace(")\\z", "").replace(")\\Z", "") for p in TEST_NAMES)


def is_test(rel: Column, is_source: Column) -> Column:
    """A test by its name, or source below a directory of tests."""
    parts = F.split(F.lower(directory(rel)), "/")
    return file_name(rel).rlike(f"^(?:{TEST_NAME})$") | (is_source & F.arrays_overlap(parts, F.array(*[F.lit(x) for x in TEST_DIRECTORIES])))


def starts_any(rel: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | rel.startswith(n)
    return out


def test_homes(base: Column) -> Column:
    """Directories where the tests of a directory may stand."""
    up, last = directory(base), file_name(base)
    return F.array(base, F.concat(base, F.lit("/tests")), F.concat(base, F.lit("/test")), F.concat(base, F.lit("/__tests__")), F.concat(F.lit("tests/"), base), F.concat(F.lit("test/"), base), F.concat(up, F.lit("/tests")), F.concat(F.lit("tests/"), last), F.lit("tests"))


def uncovered(files: DataFrame) -> DataFrame:
    """(dir, sources): directories with at least two source files and no test in any of their test homes."""
    rows = files.withColumn("dir", directory(F.col("rel")))
    sources = rows.filter(F.col("is_source") & ~F.col("is_test")).groupBy("dir").agg(F.count("*").alias("sources")).filter(F.col("sources") >= 2)
    tested = rows.filter(F.col("is_test")).select(F.col("dir").alias("home")).distinct()
    covered = sources.select("dir", F.explode(test_homes(F.col("dir"))).alias("home")).join(tested, "home").select("dir").distinct()
    return sources.join(covered, "dir", "left_anti")


def counterparts(files: DataFrame) -> DataFrame:
    """(test, source): the source file that a test belongs to, the first of the places where it may be."""
    tests = files.filter("is_test").withColumn("dir", directory(F.col("rel"))).withColumn("stem", F.regexp_replace(F.regexp_replace(file_name(F.col("rel")), r"\.[^.]+$", ""), r"^(?:test_|spec_)|(?:_test|_spec|\.test|\.spec|Tests?|Spec)$", ""))
    tests = tests.withColumn("ext", extension(file_name(F.col("rel"))))
    up = directory(F.col("dir"))
    plain = F.regexp_replace("dir", r"(?:^|/)(?:tests?|specs?|__tests__)(?=/|$)", "")
    homes = F.array("dir", up, F.concat_ws("/", up, F.lit("src")), F.regexp_replace(plain, "^/", ""), F.concat(F.lit("src"), plain), F.lit("src"), F.lit("."))
    wanted = tests.select(F.col("rel").alias("test"), F.posexplode(homes).alias("place", "home"), "stem", "ext")
    wanted = wanted.withColumn("source", F.concat(F.when(F.col("home").isin("", "."), "").otherwise(F.concat("home", F.lit("/"))), "stem", "ext"))
    found = wanted.join(files.filter("is_source and not is_test").select(F.col("rel").alias("source")), "source")
    return found.groupBy("test").agg(F.min_by("source", "place").alias("source"))


def missing_files(files: DataFrame) -> DataFrame:
    """(label, severity, rule) of each customary file that a tree lacks."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(label, names, severity, rule) for label, names, severity, rule in CUSTOMARY], "label string, names array<string>, severity string, rule string")
    found = files.select(file_name(F.col("rel")).alias("name")).filter(F.col("name").isin([n for _, names, _, _ in CUSTOMARY for n in names])).distinct()
    present = wanted.select("label", F.explode("names").alias("name")).join(found, "name").select("label").distinct()
    return wanted.join(present, "label", "left_anti").drop("names")


def mapped_lock(name: Column) -> Column:
    """The ecosystem that a lock file's name belongs to, or null."""
    return F.coalesce(*[F.when(name == n, F.lit(e)) for n, e in LOCKFILES.items()])
