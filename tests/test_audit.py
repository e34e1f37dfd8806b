import json
import os
import subprocess

import pytest

from quarrylight import cli
from quarrylight.config import Settings, load
from quarrylight.plans.audit import audit
from quarrylight.sources.git import parse_log, register

NOW = 1_700_000_000
DAY = 86_400


class Repo:
    def __init__(self, root):
        self.root = str(root)
        self.git("init", "-q", "-b", "main")

    def git(self, *args, **env):
        subprocess.run(["git", "-C", self.root, *args], check=True, capture_output=True, env=os.environ | env)

    def write(self, rel, text):
        path = os.path.join(self.root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())

    def commit(self, message, author="Ann", days=1.0, **files):
        for rel, text in files.get("files", {}).items():
            self.write(rel, text)
        when = f"@{int(NOW - days * DAY)} +0000"
        self.git("add", "-A")
        who = {f"GIT_{k}_{f}": v for k in ("AUTHOR", "COMMITTER") for f, v in (("NAME", author), ("EMAIL", f"{author.lower()}@x.org"), ("DATE", when))}
        self.git("commit", "-q", "--allow-empty", "-m", message, **who)


def branchy(n):
    return "def f(x):\n" + "".join(f"    if x > {i}:\n        x += {i}\n" for i in range(n)) + "    return x\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("tree"))
    block = "".join(f"value_{i} = compute_something({i}, 'a')\n" for i in range(25))
    r.commit("feat: start", days=20, files={
        "src/core.py": branchy(15), "src/util.py": block, "src/again.py": "# other head\n" * 3 + block, "tests/test_core.py": "import time\n\n\ndef test_a():\n    pass\n\n\ndef test_b():\n    time.sleep(1)\n    assert True\n",
        "README.md": "x" * 300, "requirements.txt": "requests==2.0.1\npytest\nflask>=1.0\n", "broken.py": "def (:\n", "node_modules/x.js": "var a = 1;\n", "image.png": b"\x89PNG\0", "__init__.py": "",
    })
    for i in range(6):
        r.commit(f"fix: step {i}", author="Ann" if i % 3 else "Bob", days=10 - i, files={"src/core.py": branchy(15) + f"# {i}\n"})
    return r


def answer(kind, key):
    if kind == "query":
        return {"results": [{"vulns": [{"id": "X-1"}] if "requests" in key else []}]}
    return {"id": key, "severity": [{"type": "CVSS_V3", "score": "9.8"}]}


@pytest.fixture(scope="module")
def result(spark, repo):
    return audit(spark, repo.root, Settings(), NOW, fetch=answer)


def test_sources(spark, repo):
    register(spark)
    rows = {r.rel: r for r in spark.read.format("source_tree").option("root", repo.root).option("exclude", "node_modules\n*.map").load().collect()}
    assert rows["node_modules/x.js"].excluded == "node_modules" and rows["image.png"].excluded == "binary" and rows["__init__.py"].excluded is None
    log = spark.read.format("git_log").option("root", repo.root).load()
    assert log.count() == 7 and log.filter(f"ts >= {NOW - 9 * DAY}").count() == 5
    assert spark.read.format("git_log").option("root", repo.root).option("since", str(int(NOW - 9.5 * DAY))).load().count() == 5
    assert {c.path for r in log.collect() for c in r.changes} >= {"src/core.py", "README.md"}
    refs = spark.read.format("git_refs").option("root", repo.root).load().collect()
    assert [(r.branch, r.is_current) for r in refs] == [("main", True)]


def test_findings(result):
    found = {(r.rule, r.file) for r in result.findings.collect()}
    expected = {
        ("complexity.complex_function", "src/core.py"), ("complexity.parse_error", "broken.py"), ("hotspots.high_churn_complex", "src/core.py"), ("tests.empty_test", "tests/test_core.py"),
        ("tests.flaky_smell", "tests/test_core.py"), ("hygiene.no_ci", None), ("hygiene.missing_file", None), ("deps.unpinned_prod", None), ("deps.dev_in_prod", "requirements.txt"), ("deps.missing_lock", None),
        ("complexity.duplication", "src/again.py"), ("deps.vulnerability", "requirements.txt"),
    }
    assert expected <= found
    assert not {r for r, _ in found} & {"hygiene.no_readme", "hygiene.dormant", "hygiene.single_author", "hygiene.conventional_commits"}


def test_scores(result):
    scores = {r.dimension: r.score for r in result.scores.collect()}
    assert set(scores) == {"complexity", "hotspots", "tests", "hygiene", "deps"} and all(s is not None for s in scores.values())
    assert 0 < result.card.first().overall < 100


def test_tree_without_history(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    run = audit(spark, str(tmp_path), Settings(), NOW)
    scores = {r.dimension: r.score for r in run.scores.collect()}
    assert scores["hotspots"] is None and scores["deps"] is None and scores["complexity"] is not None
    assert ("hygiene.history_unavailable",) in {(r.rule,) for r in run.findings.collect()}


def test_history_without_files(spark, tmp_path):
    r = Repo(tmp_path)
    for i in range(4):
        r.commit(f"step {i}", days=4 - i)
    run = audit(spark, r.root, Settings(), NOW)
    rules = {x.rule for x in run.findings.collect()}
    assert {"hotspots.history_unavailable", "hygiene.single_author", "hygiene.conventional_commits"} <= rules
    assert run.scores.filter("dimension = 'hotspots'").first().score is None


def test_command_line(spark, repo, tmp_path, capsys):
    base, out = str(tmp_path / "b.json"), str(tmp_path / "o" / "r.json")
    args = [repo.root, "--now", str(NOW)]
    assert cli.main([*args, "--write-baseline", base, "--markdown", str(tmp_path / "r.md")], spark) == cli.PASSED
    assert cli.main([*args, "--baseline", base, "--json", out, "--fail-on", "critical"], spark) == cli.PASSED
    document = json.load(open(out))
    assert document["schema_version"] == "1.0" and document["baseline_diff"]["delta"] == 0 and "## complexity" in (tmp_path / "r.md").read_text()
    changed = json.load(open(base))
    changed["findings"] = [f for f in changed["findings"] if f["rule"] != "hygiene.no_ci"]
    json.dump(changed, open(base, "w"))
    assert cli.main([*args, "--baseline", base, "--fail-below", "F"], spark) == cli.FAILED
    assert cli.main([str(tmp_path / "missing")]) == cli.BAD_USE and cli.main(["--list-rules"]) == cli.PASSED and cli.main(["--explain", "none"]) == cli.BAD_USE
    assert "new: hygiene.no_ci" in capsys.readouterr().out


def test_log_parser():
    u = "\x1f"
    text = f"a{u}Ann{u}a@x{u}100{u}p q{u}subject: with{u}unit\n\0003\t-\tbin.dat\0x\ty\tbad\0b{u}Bob{u}{u}50{u}{u}s"
    rows = list(parse_log(text.replace("\\0003", "\0" + "3").split("\0")))
    assert [r[0] for r in rows] == ["a", "b"] and rows[0][6] and rows[1][1] == "Bob" and rows[0][7] == [("bin.dat", 3, 0)]


def test_long_log_in_parts(spark, repo, monkeypatch):
    from quarrylight.sources import git as source

    reader = source._LogReader({"root": repo.root})
    whole = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.setattr(source._LogReader, "COMMITS", 3)
    assert len(reader.partitions()) == 3 and [r for p in reader.partitions() for r in reader.read(p)] == whole and len(whole) == 7
    with pytest.raises(RuntimeError):
        list(source.pieces(repo.root, "log", "no-such-branch"))
    assert [list(reader.read(p)) for p in source._LogReader({"root": "/tmp"}).partitions()] == [[]]


def test_settings(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.quarrylight]\nlarge_file_lines = 9\nbogus = 1\n[tool.quarrylight.weights]\ntests = 0.5\n')
    (tmp_path / ".quarrylightignore").write_text("# c\ngen/\ngen/\n")
    s = load(str(tmp_path), exclude=["x"])
    assert s["large_file_lines"] == 9 and s.unknown == ["bogus"] and s["weights"]["tests"] == 0.5 and s["weights"]["deps"] == 0.15
    assert s.excludes[-2:] == ["gen/", "x"] and len(s.digest()) == 12 and s.digest() != Settings().digest()
