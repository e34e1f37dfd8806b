import pytest
from pyspark.sql import functions as F

from quarrylight.functions import code
from quarrylight.functions import scalars as sc
from quarrylight.operators import paths as pt
from quarrylight.sources import manifests as mf


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_versions(spark):
    cases = [
        ("python", ">=1.0,<2.0", "1.0", False), ("npm", "^4.17.21", "4.17.21", False), ("gomod", "v1.21.0", "1.21.0", True), ("npm", "1.2.3", "1.2.3", True), ("python", "==1.2.3", "1.2.3", True),
        ("maven", "${x.y}", "x.y", False), ("gradle", "1.+", None, False), ("gradle", "[1.0,2.0)", "1.0", False), ("bundler", "~> 2.1", None, False), ("python", "", None, False), ("pub", "^1.0.0", "1.0.0", False),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "e string, s string")
    got = df.select(sc.extract_version(F.col("s"), F.col("e")), sc.is_pinned(F.col("s"), F.col("e"))).collect()
    assert [(r[0], r[1]) for r in got] == [c[2:] for c in cases]


def test_cvss(spark):
    cases = {
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8,
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:2.0/AV:N": None, "nonsense": None, "CVSS:3.1/AV:Q/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
    }
    assert column(spark, [(v,) for v in cases], "v string", sc.cvss_base(F.col("v"))) == list(cases.values())
    rounds = {4.00001: 4.1, 4.9: 4.9, 7.48224: 7.5, 4.0: 4.0}
    assert column(spark, [(v,) for v in rounds], "v double", sc.cvss_round_up(F.col("v"))) == list(rounds.values())


def test_grades_and_emails(spark):
    assert column(spark, [(95.0,), (80.0,), (59.9,), (None,)], "s double", sc.grade(F.col("s"))) == ["A", "B", "F", None]
    assert column(spark, [("ab@x",), ("abcd@x.org",), ("plain",)], "s string", sc.mask_email(F.col("s"))) == ["a*@x", "a**d@x.org", "plain"]


@pytest.mark.parametrize("pattern,rel,expected", [
    ("node_modules", "a/node_modules/b.js", True), ("*.min.js", "x/y.min.js", True), ("build/", "build", False), ("build/", "a/build/x", True), ("src/**/*.py", "src/a/b/c.py", True),
    ("src/*.py", "src/a/b.py", False), ("docs/api", "docs/api/x.md", True), ("!src", "src/a", False), ("[ab].txt", "q/b.txt", True), ("[!ab].txt", "b.txt", False),
])
def test_globs(spark, pattern, rel, expected):
    from quarrylight.sources.tree import covers

    assert column(spark, [(rel,)], "r string", pt.path_matches(F.col("r"), pattern)) == [expected] and covers(pattern, rel) == expected


def test_counterparts(spark):
    rows = [("src/a.py", True, False), ("tests/test_a.py", True, True), ("lib/b.js", True, False), ("lib/b.test.js", True, True), ("tests/test_none.py", True, True)]
    found = {r.test: r.source for r in pt.counterparts(spark.createDataFrame(rows, "rel string, is_source boolean, is_test boolean")).collect()}
    assert found == {"tests/test_a.py": "src/a.py", "lib/b.test.js": "lib/b.js"}


def test_code_metrics():
    text = "class C:\n    def m(self, a, *b, c=1):\n        for x in a:\n            if x and c or b:\n                return [y for y in b if y]\n        def inner():\n            pass\n"
    f = {x["name"]: x for x in code.python_functions(text)}
    assert (f["m"]["complexity"], f["m"]["args"], f["m"]["depth"], f["m"]["length"]) == (7, 4, 3, 6) and f["inner"]["complexity"] == 1
    go = "func Add(a int, b int) int {\n  if a > 0 {\n    return a + b // }\n  }\n  return b\n}\n"
    m = code.measure(go, "Go")
    assert [(x["name"], x["args"], x["length"], x["depth"]) for x in m["functions"]] == [("Add", 2, 6, 1)] and not m["exact"]
    assert code.measure("def (", "Python")["parse_error"] and code.empty_tests("def test_a():\n    '''x'''\n    pass\ndef test_b():\n    assert 1\n") == [1]


def test_manifests():
    names = lambda path, text: [(g, n, s) for g, n, s, _ in mf.parse(path, text)[1]]
    assert names("package.json", '{"dependencies": {"a": "^1", "b": {}}, "devDependencies": {"c": "2"}}') == [("prod", "a", "^1"), ("dev", "c", "2")]
    assert names("x/requirements-dev.txt", "# c\nfoo[extra]>=1 # x\n-r other\nhttps://x\n") == [("dev", "foo", ">=1")] and names("requirements-latest.txt", "a==1\n") == [("prod", "a", "==1")]
    assert names("go.mod", "module m\nrequire a/b v1.0.0\nrequire (\n\tc/d v2.0.0 // indirect\n)\n") == [("prod", "a/b", "v1.0.0"), ("prod", "c/d", "v2.0.0")]
    assert names("Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\n[dev-dependencies]\nc = "3"\n') == [("prod", "a", "1"), ("prod", "b", "2"), ("dev", "c", "3")]
    assert names("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>") == [("dev", "g:a", "1")]
    assert names("build.gradle", "implementation 'g:a:1.0'\ntestImplementation group: 'g', name: 'b', version: '2'\n") == [("prod", "g:a", "1.0"), ("dev", "g:b", "2")]
    assert names("Gemfile", "gem 'a', '~> 1'\ngroup :test do\n  gem 'b'\nend\ngem 'c'\n") == [("prod", "a", "~> 1"), ("dev", "b", ""), ("prod", "c", "")]
    assert names("pubspec.yaml", "dependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0\ndev_dependencies:\n  test: any\n") == [("prod", "http", "^1.0"), ("dev", "test", "any")]
    assert names("pyproject.toml", '[project]\ndependencies = ["a[x]>=1; python_version > \'3\'"]\n[dependency-groups]\nd = ["b"]\n') == [("prod", "a", ">=1; python_version > '3'"), ("dev", "b", "")]
    assert names("Pipfile", '[packages]\na = "*"\n[dev-packages]\nb = "==1"\n') == [("prod", "a", "*"), ("dev", "b", "==1")]
    assert mf.parse("package.json", "{")[2] and mf.parse("setup.py", "x") == (None, [], "")
