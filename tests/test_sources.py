import datetime

from pyspark.sql import functions as F

from quarrylight.operators import deps as dp
from quarrylight.operators.frameworks import frameworks
from quarrylight.sources import advisories as ad
from quarrylight.streaming import cadence as cd


def test_advisories_through_the_cache(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def fetch(kind, key):
        with open(calls, "a") as f:
            f.write(kind + "\n")
        if kind == "query":
            return {"results": [{"vulns": [{"id": "X-1"}]}]} if "requests" in key else {"results": [{}]}
        return {"id": key, "severity": [{"type": "CVSS_V3", "score": "9.8"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.20.0"}]}]}]}

    deps = spark.createDataFrame([("m", "python", "requests", "==2.19.0", "prod", 1), ("m", "python", "flask", "==1.0", "prod", 2), ("m", "python", "x", "==1", "dev", 3)], "manifest string, ecosystem string, name string, spec string, grp string, line int")
    wanted, cache = dp.queryable(deps), str(tmp_path / "cache")
    for _ in range(2):
        found = ad.matches(ad.answers(wanted, "query", fetch, cache, now=1000))
        details = ad.advisories(ad.answers(found.select(F.col("id").alias("key")), "advisory", fetch, cache, now=1000))
        rows = dp.vulnerable(wanted, found, dp.advisory_severity(details)).collect()
        assert [(r.name, r.severity, r.advisories) for r in rows] == [("requests", "critical", ["X-1"])] and details.first().fixed == ["2.20.0"]
    assert sorted(open(calls).read().split()) == ["advisory", "query", "query"]
    assert ad.answers(wanted, "query", lambda k, x: None, cache, now=1000 + 25 * 3600).count() == 0


def test_frameworks(spark):
    deps = spark.createDataFrame([("pytest-cov",), ("org.junit:junit",), ("left-pad",)], "name string")
    tests = spark.createDataFrame([("x = 1\nimport unittest\n",)], "text string")
    assert {r.framework for r in frameworks(deps, tests).collect()} == {"pytest", "JUnit", "unittest"}


def test_streams_agree_with_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=5 * i), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, author bigint")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = cd.cadence(stream).writeStream.format("memory").queryName("cadence").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cadence").agg(F.sum("commits")).first()[0] == 60
    q = cd.longest_pauses(stream).writeStream.format("memory").queryName("pauses").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.author, r.longest) for r in spark.table("pauses").collect()} == {(a, 15 * 3600) for a in range(3)}
