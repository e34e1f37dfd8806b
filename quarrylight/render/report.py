"""A report is a plain dictionary, small enough for the driver; JSON, Markdown and console text are made from it."""

from __future__ import annotations

import json
import os
from typing import Any

from ..catalogue import RULES
from ..operators import findings as fi
from ..plans.audit import Audit

SCHEMA_VERSION = "1.0"


def measurements(run: Audit) -> dict[str, Any]:
    """The measurements by part; gathered in one pass, as there are some dozens of short rows."""
    out: dict[str, Any] = {}
    for part, key, row in run.measured.collect():
        mine, values = out.setdefault(part, {}), json.loads(row)
        if not key:
            mine.update(values)
        elif key == "online":
            mine[key] = values
        elif key == "findings_capped":
            mine.setdefault(key, {})[values["rule"]] = values["dropped"]
        else:
            mine.setdefault(key, []).append(next(iter(values.values())) if len(values) == 1 else values)
    exact = out.get("complexity", {})
    if exact.get("files_heuristic"):
        exact["notes"] = [f"{exact['files_heuristic']} of {exact['files_measured']} files measured with heuristics (exact for Python only)"]
    return out


def report(run: Audit, name: str) -> dict[str, Any]:
    """All capped findings in order, of which there are a dozen for each rule, with scores and what was not measured."""
    known = {r.id: r for r in RULES}
    columns = ("rule", "dimension", "severity", "confidence", "detail", "file", "line", "occurrences", "evidence")
    rows = []
    for r in run.findings.orderBy(*fi.order_by()).collect():
        places = [x.asDict() for x in r["locations"] or []]
        rows.append({k: r[k] for k in columns} | {"penalty": float(r["penalty"]), "locations": places, "title": known[r["rule"]].title, "remediation": known[r["rule"]].remedy})
    card = run.card.first().asDict()
    scores = [r.asDict() for r in run.scores.orderBy("ordinal").collect()]
    metrics = run.metrics | measurements(run)
    missing = [d["dimension"] for d in scores if d["score"] is None]
    note = f"{card['coverage']:.0%} of the weight was measured" + (f"; not measured: {', '.join(missing)}" if missing else "") if card["coverage"] is not None else "nothing was measured"
    return {"schema_version": SCHEMA_VERSION, "name": name, "overall": card["overall"], "grade": card["grade"], "coverage": card["coverage"], "note": note, "dimensions": scores, "findings": rows, "unavailable": run.unavailable, "metrics": metrics}


def write_json(document: dict[str, Any], path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2)


def read_baseline(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def diff(current: dict[str, Any], baseline: dict[str, Any], tolerance: float = 0.0) -> dict[str, Any]:
    """New, resolved, increased and decreased rules and the change of the overall score, both at one decimal."""
    count = lambda d: {r: sum(f["occurrences"] for f in d["findings"] if f["rule"] == r) for r in {f["rule"] for f in d["findings"]}}
    before, after = count(baseline), count(current)
    rounded = lambda d: None if d["overall"] is None else round(d["overall"], 1)
    a, b = rounded(baseline), rounded(current)
    delta = None if a is None or b is None else round(b - a, 1)
    scores = lambda d: {x["dimension"]: round(x["score"], 1) for x in d["dimensions"] if x["score"] is not None}
    then, now = scores(baseline), scores(current)
    return {
        "dimensions": {d: {"before": then[d], "after": now[d], "delta": round(now[d] - then[d], 1)} for d in now if d in then and now[d] != then[d]},
        "new": sorted(after.keys() - before.keys()),
        "resolved": sorted(before.keys() - after.keys()),
        "increased": sorted(r for r in after.keys() & before.keys() if after[r] > before[r]),
        "decreased": sorted(r for r in after.keys() & before.keys() if after[r] < before[r]),
        "delta": delta,
        "score_drop": delta is not None and delta < -tolerance,
        "config_changed": current["metrics"].get("config") != baseline["metrics"].get("config"),
    }


def regressed(change: dict[str, Any]) -> bool:
    return bool(change["new"] or change["increased"] or change["score_drop"])


def _score(value: float | None) -> str:
    return "not measured" if value is None else f"{value:.1f}"


def _place(f: dict[str, Any]) -> str:
    return "" if f["file"] is None else f["file"] if f["line"] is None else f"{f['file']}:{f['line']}"


def markdown(document: dict[str, Any]) -> str:
    out = [f"# {document['name']}", "", f"Overall: **{_score(document['overall'])}** ({document['grade'] or '-'})", "", "| dimension | score | grade | findings |", "| --- | --- | --- | --- |"]
    out += [f"| {d['dimension']} | {_score(d['score'])} | {d['grade'] or '-'} | {d['n_findings']} |" for d in document["dimensions"]]
    for d in document["dimensions"]:
        mine = [f for f in document["findings"] if f["dimension"] == d["dimension"]]
        if mine:
            out += ["", f"## {d['dimension']}", ""]
            for f in mine:
                out.append(f"- **{f['severity']}** `{f['rule']}` {f['title']}: {_place(f)} {f['detail'] or ''}" + (f" (x{f['occurrences']})" if f["occurrences"] > 1 else ""))
                out += [f"  - {x}" for x in f["evidence"]]
                out += [f"  - see {_place(x)}" for x in f["locations"][1:]]
    if any(isinstance(v, dict) for v in document["metrics"].values()):
        out += ["", "## Measurements", ""]
        for part, values in document["metrics"].items():
            if isinstance(values, dict):
                out += [f"- {part}: " + ", ".join(f"{k} {v}" for k, v in values.items() if not isinstance(v, (list, dict)))]
    if document["unavailable"]:
        out += ["", "## Not measured", "", *[f"- {k}: {v}" for k, v in sorted(document["unavailable"].items())]]
    return "\n".join(out) + "\n"


# Terminal colours by severity.
_COLOURS = {"critical": 35, "high": 31, "medium": 33, "low": 36, "info": 37}


def console(document: dict[str, Any], width: int = 78, colour: bool = False, verbose: bool = False, encoding: str = "utf-8") -> str:
    """Text for a terminal; bars of plain signs where the encoding has no others; ``verbose`` adds evidence, places and measurements."""
    try:
        "\u2588\u2591".encode(encoding)
        full, free = "\u2588", "\u2591"
    except (UnicodeEncodeError, LookupError):
        full, free = "#", "."
    painted = lambda text, severity: f"\x1b[{_COLOURS[severity]}m{text}\x1b[0m" if colour else text
    bar = lambda s: " " * 10 if s is None else full * round(s / 10) + free * (10 - round(s / 10))
    out = ["=" * width, f"{document['name']}: {_score(document['overall'])} {document['grade'] or ''}".rstrip(), document["note"], "=" * width]
    out += [f"{d['dimension']:<12}{bar(d['score'])}{_score(d['score']):>14}  {d['grade'] or '-'}  {d['n_findings']:>4} findings" for d in document["dimensions"]]
    for f in document["findings"]:
        head = f"{f['severity'].upper():<9}"
        out.append(painted(head, f["severity"]) + f"{f['rule']:<34}{_place(f)}"[: width - len(head)])
        if verbose:
            out += [f"         {x}"[:width] for x in [f["detail"], *f["evidence"], *(_place(x) for x in f["locations"][1:])] if x]
    if verbose:
        for part, values in document["metrics"].items():
            if isinstance(values, dict):
                out += [f"{part}: {k} = {v}"[:width] for k, v in values.items() if not isinstance(v, (list, dict))]
    if document["unavailable"]:
        out += ["NOT MEASURED", *[f"  {k}: {v}"[:width] for k, v in sorted(document["unavailable"].items())]]
    return "\n".join(out) + "\n"


def diff_text(change: dict[str, Any]) -> str:
    out = [f"{kind}: {rule}" for kind in ("new", "increased") for rule in change[kind]][:20]
    out += [f"{d}: {x['before']:.1f} to {x['after']:.1f} ({x['delta']:+.1f})" for d, x in change.get("dimensions", {}).items() if x["delta"] < 0]
    if change["score_drop"]:
        out.append(f"score fell by {-change['delta']:.1f}")
    if out and change["config_changed"]:
        out.append("note: the settings changed since the baseline")
    return "\n".join(out or ["no regressions"]) + "\n"
