"""Settings: defaults, overlaid by a TOML file, by an ignore file and by the command line."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

# Fixed values.
DEFAULTS: dict[str, Any] = {
    "weights": {"complexity": 0.25, "tests": 0.25, "hotspots": 0.20, "deps": 0.15, "hygiene": 0.15},
    "grade_bands": {"A": 90.0, "B": 80.0, "C": 70.0, "D": 60.0, "F": 0.0},
    "budget": {"complexity": 40.0, "hotspots": 30.0, "tests": 40.0, "hygiene": 30.0, "deps": 30.0},
    "max_findings_per_rule": 12,
    "critical_grade_cap": 89.0,
    "history_window_days": 180,
    "dormant_days": 90,
    "hotspot_min_commits": 3,
    "large_file_lines": 500,
    "long_function_lines": 60,
    "complex_function_score": 12,
    "max_nesting_depth": 4,
    "max_parameters": 6,
    "long_line_chars": 120,
    "max_long_line_ratio": 0.15,
    "duplication_window": 10,
    "duplication_min_lines": 20,
    "test_file_lines": 800,
    "test_min_ratio": 0.15,
    "test_min_assertions_per_100_lines": 2.0,
    "dormant_branch_days": 90,
    "bus_factor_min_authors": 2,
    "conventional_commit_min_ratio": 0.6,
    "max_merge_ratio": 0.45,
    "min_merge_ratio": 0.05,
    "large_blob_bytes": 512_000,
    "min_readme_chars": 200,
    "online": False,
    "cache_ttl_hours": 24,
    "cache_dir": "",
    "max_file_bytes": 2 * 1024 * 1024,
    "exclude": [],
    "include": [],
}
# Never source, whatever the settings say.
ALWAYS_EXCLUDED = (
    ".git .hg .svn node_modules vendor third_party 3rdparty .venv venv env .tox .nox __pycache__ .mypy_cache .pytest_cache .ruff_cache "
    ".gradle .idea .vscode dist build target out coverage htmlcov .next .nuxt .cache .terraform site-packages .eggs *.egg-info *.min.js "
    "*.min.css *.bundle.js *.map *.pb.go *_pb2.py *.pb.cc *.pb.h *_generated.go *.g.dart *.designer.cs *.min.map"
).split()
SETTINGS_FILE, SETTINGS_TABLE, IGNORE_FILE = "quarrylight.toml", "quarrylight", ".quarrylightignore"


@dataclass
class Settings:
    values: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))
    unknown: list[str] = field(default_factory=list)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    @property
    def excludes(self) -> list[str]:
        return [*ALWAYS_EXCLUDED, *dict.fromkeys(self.values["exclude"])]

    def overlay(self, found: dict[str, Any], where: str = "") -> Settings:
        """Takes over known keys, nested tables by key; notes the others."""
        for key, value in found.items():
            if key not in DEFAULTS:
                self.unknown.append(f"{where}{key}")
            elif isinstance(DEFAULTS[key], dict) and isinstance(value, dict):
                self.unknown += [f"{where}{key}.{k}" for k in value if k not in DEFAULTS[key]]
                self.values[key] |= {k: v for k, v in value.items() if k in DEFAULTS[key]}
            else:
                self.values[key] = value
        return self

    def digest(self) -> str:
        """Twelve hex digits that change with any setting."""
        return hashlib.sha256(json.dumps(self.values, sort_keys=True).encode()).hexdigest()[:12]


def ignore_patterns(text: str) -> list[str]:
    """One glob a line; comments and repeats dropped."""
    lines = (line.strip() for line in text.splitlines())
    return list(dict.fromkeys(line for line in lines if line and not line.startswith("#")))


def load(root: str, path: str | None = None, exclude: list[str] | None = None, include: list[str] | None = None) -> Settings:
    """The settings of a tree: an explicit file, else its own file, else a table in pyproject.toml; then its ignore file."""
    out, found = Settings(), {}
    own, project = os.path.join(root, SETTINGS_FILE), os.path.join(root, "pyproject.toml")
    if path or os.path.exists(own):
        with open(path or own, "rb") as f:
            found = tomllib.load(f)
    elif os.path.exists(project):
        with open(project, "rb") as f:
            found = tomllib.load(f).get("tool", {}).get(SETTINGS_TABLE, {})
    out.overlay(found)
    ignore = os.path.join(root, IGNORE_FILE)
    extra = []
    if os.path.exists(ignore):
        with open(ignore, encoding="utf-8") as f:
            extra = ignore_patterns(f.read())
    out.values["exclude"] = [*out.values["exclude"], *extra, *(exclude or [])]
    out.values["include"] = [*out.values["include"], *(include or [])]
    return out
