"""Parsers of dependency manifests: a text to (group, name, spec, line) rows, or an error."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

Row = tuple[str, str, str, int]  # group, name, spec, line


def _line(text: str, name: str) -> int:
    at = text.find(f'"{name}"')
    at = text.find(name) if at < 0 else at
    return text.count("\n", 0, at) + 1 if at >= 0 else 0


def _json_groups(groups: dict[str, str], skip: Callable[[str], bool] = lambda n: False) -> Callable[[str], Iterator[Row]]:
    def parse(text: str) -> Iterator[Row]:
        data = json.loads(text)
        for key, group in groups.items():
            for name, spec in (data.get(key) or {}).items():
                if isinstance(spec, str) and not skip(name):
                    yield group, name, spec, _line(text, name)

    return parse


package_json = _json_groups({"dependencies": "prod", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"})
composer_json = _json_groups({"require": "prod", "require-dev": "dev"}, lambda n: n == "php" or n.startswith("ext-"))

_REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")
# Words that mark a requirements file as one for development.
_DEVELOPMENT = frozenset(["dev", "devel", "test", "testing", "tests", "contrib"])


def requirements(text: str, path: str = "requirements.txt") -> Iterator[Row]:
    parts = path.rsplit(".", 1)[0].split("/")
    group = "dev" if any(w in _DEVELOPMENT for p in [*parts[1:-1], parts[-1]] for w in re.split(r"[^a-z]+", p.lower())) else "prod"
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*", "", raw).strip()
        if not line or line.startswith(("-", ".", "/")) or "://" in line:
            continue
        if m := _REQUIREMENT.match(line):
            yield group, m[1], m[2].strip(), number


def _requirement(text: str) -> tuple[str, str]:
    m = re.match(r"^\s*([^\[<>=!~;\s]+)\s*(?:\[[^\]]*\])?\s*(.*)$", text)
    return (m[1], m[2].strip()) if m else (text, "")


def pyproject(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    project = data.get("project", {})
    lists = [("prod", project.get("dependencies", []))]
    lists += [("optional", x) for x in project.get("optional-dependencies", {}).values()]
    lists += [("dev", x) for x in data.get("dependency-groups", {}).values()]
    lists.append(("dev", data.get("build-system", {}).get("requires", [])))
    for group, items in lists:
        for item in items:
            if isinstance(item, str):
                name, spec = _requirement(item)
                yield group, name, spec, _line(text, name)
    poetry = data.get("tool", {}).get("poetry", {})
    tables = [("prod", poetry.get("dependencies", {})), ("dev", poetry.get("dev-dependencies", {}))]
    tables += [("dev", g.get("dependencies", {})) for g in poetry.get("group", {}).values()]
    for group, found in tables:
        for name, spec in found.items():
            if name != "python":
                yield group, name, spec if isinstance(spec, str) else str(spec.get("version", "")) if isinstance(spec, dict) else "", _line(text, name)


def pipfile(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    for key, group in (("packages", "prod"), ("dev-packages", "dev")):
        for name, spec in data.get(key, {}).items():
            yield group, name, spec if isinstance(spec, str) else str(spec.get("version", "")), _line(text, name)


def go_mod(text: str) -> Iterator[Row]:
    inside = False
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("//")[0].strip()
        if line.startswith("require ("):
            inside = True
        elif line == ")":
            inside = False
        elif line.startswith("require ") or inside:
            parts = line.removeprefix("require ").split()
            if len(parts) >= 2:
                yield "prod", parts[0], parts[1], number


def cargo(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    tables = [("prod", data.get("dependencies", {})), ("dev", data.get("dev-dependencies", {}))]
    for target in data.get("target", {}).values():
        tables += [("prod", target.get("dependencies", {})), ("dev", target.get("dev-dependencies", {}))]
    for group, found in tables:
        for name, spec in found.items():
            yield group, name, spec if isinstance(spec, str) else str(spec.get("version", "")), _line(text, name)


def pom(text: str) -> Iterator[Row]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        field = lambda tag: (re.search(rf"<{tag}>\s*([^<]*?)\s*</{tag}>", m[1]) or [None, ""])[1]  # noqa: B023, E731
        if field("groupId") and field("artifactId"):
            group = "dev" if field("scope") in ("test", "provided") else "prod"
            yield group, f"{field('groupId')}:{field('artifactId')}", field("version"), text.count("\n", 0, m.start()) + 1


_GRADLE = re.compile(r"^\s*(\w+)\s*[( ]\s*(?:[\"']([^\"':]+):([^\"':]+)(?::([^\"']*))?[\"']|group\s*[:=]\s*[\"']([^\"']+)[\"']\s*,\s*name\s*[:=]\s*[\"']([^\"']+)[\"'](?:\s*,\s*version\s*[:=]\s*[\"']([^\"']*)[\"'])?)")
# Configurations that ship, and that only tests use.
_GRADLE_PROD = frozenset("implementation api compile runtimeOnly compileOnly runtime annotationProcessor kapt".split())
_GRADLE_TEST = frozenset("testImplementation testCompile testRuntimeOnly testRuntime testCompileOnly androidTestImplementation testApi".split())


def gradle(text: str) -> Iterator[Row]:
    for number, line in enumerate(text.splitlines(), 1):
        if m := _GRADLE.match(line):
            group = "prod" if m[1] in _GRADLE_PROD else "dev" if m[1] in _GRADLE_TEST else None
            if group:
                yield group, f"{m[2] or m[5]}:{m[3] or m[6]}", m[4] or m[7] or "", number


def gemfile(text: str) -> Iterator[Row]:
    group, depth = "prod", 0
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#")[0].strip()
        if m := re.match(r"group\s+(.*?)\s+do\b", line):
            group, depth = ("dev" if re.search(r":(test|development)\b", m[1]) else "prod"), depth + 1
        elif line == "end" and depth:
            group, depth = "prod", depth - 1
        elif m := re.match(r"gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", line):
            yield group, m[1], m[2] or "", number


def pubspec(text: str) -> Iterator[Row]:
    group = None
    for number, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"^(\w+):\s*$", line):
            group = {"dependencies": "prod", "dev_dependencies": "dev"}.get(m[1])
        elif group and (m := re.match(r"^  ([A-Za-z_]\w*):\s*(.*)$", line)) and m[1] not in ("sdk", "flutter"):
            yield group, m[1], m[2].strip().strip("\"'"), number


# Which parser reads which file.
PARSERS: dict[str, tuple[str, Callable]] = {
    "package.json": ("npm", package_json), "composer.json": ("composer", composer_json), "pyproject.toml": ("python", pyproject), "Pipfile": ("python", pipfile), "go.mod": ("gomod", go_mod),
    "Cargo.toml": ("cargo", cargo), "pom.xml": ("maven", pom), "build.gradle": ("gradle", gradle), "build.gradle.kts": ("gradle", gradle), "Gemfile": ("bundler", gemfile), "pubspec.yaml": ("pub", pubspec),
}


def parse(path: str, text: str) -> tuple[str | None, list[Row], str]:
    """(ecosystem, rows, error); the ecosystem is null for a file that no parser reads."""
    name = path.rsplit("/", 1)[-1]
    if re.match(r"^(requirements|constraints).*\.(txt|in)$", name):
        return "python", list(requirements(text, path)), ""
    if name not in PARSERS:
        return None, [], ""
    ecosystem, parser = PARSERS[name]
    try:
        return ecosystem, list(parser(text)), ""
    except (ValueError, AttributeError, TypeError) as problem:
        return ecosystem, [], str(problem)


def manifests(files):
    """files (rel, text) to (manifest, ecosystem, error, deps array<struct<grp, name, spec, line>>), in Arrow batches."""
    import pandas as pd
    from pyspark.sql import functions as F

    kind = "manifest string, ecosystem string, error string, deps array<struct<grp:string,name:string,spec:string,line:int>>"

    def run(batches):
        for pdf in batches:
            rows = []
            for rel, text in zip(pdf["rel"], pdf["text"], strict=True):
                ecosystem, found, error = parse(rel, text or "")
                if ecosystem:
                    rows.append((rel, ecosystem, error, [dict(zip(("grp", "name", "spec", "line"), r, strict=True)) for r in found]))
            yield pd.DataFrame(rows, columns=["manifest", "ecosystem", "error", "deps"])

    names = [*PARSERS]
    name = F.regexp_extract("rel", "([^/]*)$", 1)
    return files.filter(name.isin(names) | name.rlike(r"^(requirements|constraints).*\.(txt|in)$")).select("rel", "text").mapInPandas(run, kind)
