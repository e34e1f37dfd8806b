"""The command line: python -m quarrylight.cli PATH [options]. Exit code 0: passed, 1: a gate failed, 2: bad use."""

from __future__ import annotations

import argparse
import os
import sys

from .catalogue import DIMENSIONS, RULES, SEVERITY_RANK
from .config import load
from .render import report as rp

PASSED, FAILED, BAD_USE = 0, 1, 2
GRADES = "ABCDF"


def listing() -> str:
    groups = sorted(DIMENSIONS, key=lambda d: -sum(r.dimension == d for r in RULES))
    return "\n".join(f"{r.id:<36}{r.severity:<10}{r.title}" for d in groups for r in RULES if r.dimension == d)


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="quarrylight", description="Audit the health of a source tree.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--config")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--only", action="append", choices=DIMENSIONS)
    p.add_argument("--skip", action="append", choices=DIMENSIONS, default=[])
    p.add_argument("--json")
    p.add_argument("--markdown")
    p.add_argument("--baseline")
    p.add_argument("--write-baseline")
    p.add_argument("--max-drop", type=float, default=0.0)
    p.add_argument("--fail-below", choices=list(GRADES))
    p.add_argument("--fail-on", choices=list(SEVERITY_RANK))
    p.add_argument("--now", type=int)
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--explain")
    p.add_argument("-v", "--verbose", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as stop:
        return BAD_USE if stop.code else PASSED
    if a.list_rules:
        print(listing())
        return PASSED
    if a.explain:
        found = [r for r in RULES if r.id == a.explain]
        print("\n".join(f"{r.id} ({r.severity}): {r.title}. {r.remedy}" for r in found) or f"no rule {a.explain}", file=sys.stdout if found else sys.stderr)
        return PASSED if found else BAD_USE
    if not os.path.isdir(a.path):
        print(f"no such folder: {a.path}", file=sys.stderr)
        return BAD_USE
    try:
        settings = load(a.path, a.config, a.exclude, a.include)
    except (OSError, ValueError) as problem:
        print(f"settings: {problem}", file=sys.stderr)
        return BAD_USE
    for key in settings.unknown:
        print(f"unknown setting: {key}", file=sys.stderr)
    from .plans.audit import audit

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quarrylight").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    only = (set(a.only) if a.only else set(DIMENSIONS)) - set(a.skip)
    document = rp.report(audit(spark, os.path.abspath(a.path), settings, a.now, None if only == set(DIMENSIONS) else only), os.path.basename(os.path.abspath(a.path)))
    code = PASSED
    if a.write_baseline:
        rp.write_json(document, a.write_baseline)
    change = None
    if a.baseline:
        change = rp.diff(document, rp.read_baseline(a.baseline), a.max_drop)
        code = FAILED if rp.regressed(change) else code
    if a.json:
        rp.write_json(document | ({"baseline_diff": change} if change else {}), a.json)
    if a.markdown:
        os.makedirs(os.path.dirname(os.path.abspath(a.markdown)), exist_ok=True)
        with open(a.markdown, "w", encoding="utf-8") as f:
            f.write(rp.markdown(document))
    print(rp.console(document, colour=sys.stdout.isatty() and not os.environ.get("NO_COLOR"), verbose=a.verbose, encoding=getattr(sys.stdout, "encoding", None) or "ascii"), end="")
    if change:
        print(rp.diff_text(change), end="")
    if a.fail_below and document["grade"] and GRADES.index(document["grade"]) > GRADES.index(a.fail_below):
        code = FAILED
    if a.fail_on and any(SEVERITY_RANK[f["severity"]] >= SEVERITY_RANK[a.fail_on] for f in document["findings"]):
        code = FAILED
    return code


if __name__ == "__main__":
    sys.exit(main())
