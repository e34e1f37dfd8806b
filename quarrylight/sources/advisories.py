"""Advisories for dependencies: from an injected fetcher, through a cache table of Parquet files that expires.

The fetcher is a function (kind, key) -> dict or None, kind being "query" or "advisory"; http_fetcher() makes the one
that asks the public database. All failures count as no answer, and are not cached.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The public advisory database's addresses and the time it is given to answer.
QUERY_URL, ADVISORY_URL, TIMEOUT = "https://api.osv.dev/v1/querybatch", "https://api.osv.dev/v1/vulns", 20
CACHE_SCHEMA = "kind string, key string, body string, fetched_at bigint"
ADVISORY_SCHEMA = (
    "struct<id:string,summary:string,aliases:array<string>,severity:array<struct<type:string,score:string>>,"
    "database_specific:struct<severity:string>,affected:array<struct<ranges:array<struct<events:array<struct<fixed:string>>>>>>>"
)


def http_fetcher() -> Callable[[str, str], dict | None]:
    def fetch(kind: str, key: str) -> dict | None:
        try:
            if kind == "query":
                ecosystem, name, version = json.loads(key)
                body = json.dumps({"queries": [{"package": {"ecosystem": ecosystem, "name": name}, "version": version}]}).encode()
                request = urllib.request.Request(QUERY_URL, body, {"Content-Type": "application/json"})
            else:
                request = urllib.request.Request(f"{ADVISORY_URL}/{key}")
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            return None

    return fetch


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path) if path else spark.createDataFrame([], CACHE_SCHEMA)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def answers(keys: DataFrame, kind: str, fetch: Callable[[str, str], dict | None], cache_path: str | None = None, ttl_hours: float = 24, now: int | None = None) -> DataFrame:
    """(key, body json) for (key) rows: fresh cache rows, and what is fetched for the rest, which the cache then holds."""
    spark, now = keys.sparkSession, int(now if now is not None else time.time())
    cache = read_cache(spark, cache_path).filter((F.col("kind") == kind) & (F.col("fetched_at") >= now - int(ttl_hours * 3600)))
    cached = keys.select("key").distinct().join(cache.groupBy("key").agg(F.max_by("body", "fetched_at").alias("body")), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, fetch(kind, k)) for k in pdf["key"]]
            yield pd.DataFrame([(k, json.dumps(b)) for k, b in found if b is not None], columns=["key", "body"])

    fetched = keys.select("key").distinct().join(cached, "key", "left_anti").mapInPandas(run, "key string, body string")
    if not cache_path:
        return cached.unionByName(fetched.persist())
    # written first and read back, so that a lost executor asks nothing again
    fetched.select(F.lit(kind).alias("kind"), "key", "body", F.lit(now).cast("bigint").alias("fetched_at")).write.mode("append").parquet(cache_path)
    fresh = read_cache(spark, cache_path).filter((F.col("kind") == kind) & (F.col("fetched_at") >= now - int(ttl_hours * 3600)))
    return keys.select("key").distinct().join(fresh.groupBy("key").agg(F.max_by("body", "fetched_at").alias("body")), "key")


def matches(answered: DataFrame) -> DataFrame:
    """(key, id): the advisories that answers to queries name."""
    body = F.from_json("body", "struct<results:array<struct<vulns:array<struct<id:string>>>>>")
    return answered.select("key", F.explode(F.flatten(F.transform(body["results"], lambda r: F.coalesce(r["vulns"], F.array().cast("array<struct<id:string>>"))))).alias("v")).select("key", F.col("v.id").alias("id"))


def advisories(answered: DataFrame) -> DataFrame:
    """(id, summary, aliases, scores, database_severity, fixed array<string>) of answers for advisories."""
    a = answered.select("key", F.from_json("body", ADVISORY_SCHEMA).alias("a"))
    none = F.array().cast("array<string>")
    ranges = F.flatten(F.transform("a.affected", lambda x: F.coalesce(x["ranges"], F.array().cast("array<struct<events:array<struct<fixed:string>>>>"))))
    events = F.flatten(F.transform(ranges, lambda r: F.coalesce(r["events"], F.array().cast("array<struct<fixed:string>>"))))
    fixed = F.array_compact(F.transform(events, lambda e: e["fixed"]))
    return a.select(
        F.col("key").alias("id"), "a.summary", F.coalesce("a.aliases", none).alias("aliases"), F.coalesce("a.severity", F.array().cast("array<struct<type:string,score:string>>")).alias("scores"),
        F.col("a.database_specific.severity").alias("database_severity"), F.coalesce(fixed, none).alias("fixed"),
    )
