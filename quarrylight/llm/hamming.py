"""Exact top-k search in Hamming space by incremental multi-index hashing.

A binary code is cut into m segments of about log2(n) bits, n being the number of distinct codes, so that a segment's value
is shared by a few codes. The index holds a posting (key, code) for every segment of every code, a key being a segment's
number and value. If two codes differ in fewer than m * (r + 1) bits, one of their segments differs in at most r bits; if in
at most m * r + s bits, one of the segments 0 to s does, or one of the others differs in fewer than r. So the search
radius grows step by step, and where a radius has many values, segment by segment: a step probes, for every query that is
still open, the values that differ from its own in exactly r bits, as one equi-join with the postings, and computes the
whole distances of the codes it meets. A query closes once its k-th distance is so small that nothing nearer can be left.
Codes farther than the k nearest met so far are passed over at once. A code is met in one segment and step alone, the first
in order, so candidates are not repeated. When r has reached the segments' width everything has been met, so results are
always exact.

Codes that repeat are one code with a count and the k least ids; the same holds for queries. The postings are bucketed, so
that only the probes are shuffled; a value that very many codes share is split into parts. Probes are far more than the
rows they are made of, which Spark does not foresee: it would broadcast them, so their join names its kind.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table
from .common import bucketed, dropped, small_side, spread_join, written

#: A key holds the value of a segment (segments of 64 bits have at most 32), above this bit its number ..
_NUMBER_BIT = 32
#: .. and above this one the part of a value that is split.
_PART_BIT = 38


def sign_code(vector: Column | str, bits: int = 64) -> Column:
    """The signs of the first ``bits`` (at most 64) elements as one bigint: bit i is set if element i is positive.

    Missing and null elements and NaN count as not positive; a null vector has a null code."""
    v = F.col(vector) if isinstance(vector, str) else vector
    code = F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        F.lit(0).cast("bigint"),
        lambda a, i: F.when(
            (F.get(v, i) > 0) & ~F.isnan(F.get(v, i)), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        ).otherwise(a),
    )
    return F.when(v.isNotNull(), code)


def segment_widths(codes: int, bits: int) -> list[int]:
    """Widths of the segments, as equal as can be, of at most log2(codes) bits each."""
    m = min(bits, max(1, math.ceil(bits / max(1.0, math.log2(max(codes, 2))))))
    return [bits // m + (i < bits % m) for i in range(m)]


def _segments(code: Column, widths: list[int]) -> list[Column]:
    """The values of a code's segments."""
    at = [sum(widths[:i]) for i in range(len(widths))]
    return [F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for a, w in zip(at, widths, strict=True)]


def _keys(code: Column, widths: list[int], segments: list[int]) -> Column:
    """array<bigint>: number and value of some of a code's segments."""
    values = _segments(code, widths)
    return F.array(*[values[i].bitwiseOR(F.lit(i << _NUMBER_BIT).cast("bigint")) for i in segments])


def _in_part(key: str, part: Column) -> Column:
    return F.col(key).bitwiseOR(F.shiftleft(part.cast("bigint"), _PART_BIT))


def _flips(width: int, radius: int) -> Column:
    """array<bigint>, constant: all values of ``width`` bits of which ``radius`` are set."""
    found = ",".join(str(sum(1 << b for b in c)) for c in combinations(range(width), radius))
    return F.split(F.lit(found), ",").cast("array<bigint>") if found else F.array().cast("array<bigint>")


def search_steps(widths: list[int], most_flips: int) -> list[tuple[int, list[int]]]:
    """(radius, segments) in the order of the search: all segments at once while a radius has at most most_flips values."""
    every, steps = list(range(len(widths))), []
    for radius in range(max(widths) + 1):
        steps += [(radius, every)] if math.comb(max(widths), radius) <= most_flips else [(radius, [s]) for s in every]
    return steps


def _probes(open_: DataFrame, widths: list[int], radius: int, segments: list[int], hot: DataFrame) -> DataFrame:
    """(q, bound, key): what the open queries (q, bound) look up in these segments at this radius."""
    per_segment = open_.select("q", "bound", F.explode(_keys(F.col("q"), widths, segments)).alias("own"))
    flips = _flips(widths[segments[0]], radius)
    for i in segments:
        if widths[i] != widths[segments[0]]:
            flips = F.when(F.col("own") < i << _NUMBER_BIT, flips).otherwise(_flips(widths[i], radius))
            break
    values = per_segment.select("q", "bound", "own", F.explode(flips).alias("flip")).select("q", "bound", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return values.join(hot, "key", "left").select("q", "bound", "key", F.explode(parts).alias("part")).select("q", "bound", _in_part("key", F.col("part")).alias("key"))


def _first_met(widths: list[int], radius: int) -> Column:
    """Whether a code that query q meets by key at this radius was met in no other segment or step before."""
    s = F.shiftright("key", _NUMBER_BIT).bitwiseAND(F.lit(63).cast("bigint"))
    apart = [F.bit_count(x) for x in _segments(F.col("q").bitwiseXOR(F.col("code")), widths)]
    return reduce(and_, [d >= F.when(s > i, radius + 1).otherwise(radius) for i, d in enumerate(apart)])


def hamming_topk(base: DataFrame, queries: DataFrame, k: int, bits: int = 64, most_postings: int = 50_000, most_flips: int = 1_000) -> DataFrame:
    """The k nearest base rows of every query.

    base, queries: (id, code); other columns are ignored. Rows with a null id or code take no part, a repeated (id, code)
    row counts once; a query id with several codes is searched with the least. Returns (query_id, rank, neighbor_id,
    distance), rank from 1 by distance and then id; fewer than k rows only if base holds fewer; none for an empty base. A
    query that is itself a base row finds itself at distance 0. A value with more than ``most_postings`` postings is split;
    segments are searched one by one at radii of more than ``most_flips`` values.
    """
    clean = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("code").cast("bigint").alias("code")).dropna()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = clean(base).dropDuplicates().withColumn("at", first).filter(F.col("at") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes = written(codes, "mih-codes")
    asked = written(clean(queries).groupBy("id").agg(F.min("code").alias("q")), "mih-queries")
    facts = codes.agg(F.count("*").alias("n"), F.sum(F.size("ids").cast("bigint")).alias("rows")).first()
    widths, need = segment_widths(facts["n"], bits), min(k, facts["rows"] or 0)

    postings = codes.select("code", F.get("ids", F.lit(0)).alias("id"), F.size("ids").alias("times"), F.explode(_keys(F.col("code"), widths, list(range(len(widths))))).alias("key"))
    parts = F.ceil(F.count("*") / most_postings).cast("int")
    hot = small_side(written(postings.groupBy("key").agg(parts.alias("parts")).filter(F.col("parts") > 1), "mih-hot"))
    part = F.pmod(F.xxhash64("code"), F.coalesce("parts", F.lit(1))).cast("int")
    index = postings.join(hot, "key", "left").select(_in_part("key", part).alias("key"), "code", "id", "times")
    buckets = min(10_000, 8 + facts["n"] * len(widths) // 1_000_000)
    index = bucketed(index.repartition(buckets, "key"), "mih-index", ["key"], buckets)

    best, open_ = None, asked.select("q", F.lit(bits).alias("bound")).distinct()
    nearest = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    for radius, segments in search_steps(widths, most_flips):
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = _probes(open_, widths, radius, segments, hot).join(index.hint("shuffle_hash"), "key").filter((distance <= F.col("bound")) & _first_met(widths, radius))
        met = met.select("q", "code", "id", "times", distance.alias("distance"))
        before = best, open_
        # ties go to the least id, so k codes by distance and least id hold the k nearest rows
        best = written((met if best is None else met.unionByName(best)).withColumn("at", nearest).filter(F.col("at") <= k).drop("at"), "mih-best")
        sure = F.sum(F.when(F.col("distance") <= len(widths) * radius + segments[-1], F.col("times")))
        known = best.groupBy("q").agg(sure.alias("sure"), F.sum("times").alias("met"), F.max("distance").alias("far"))
        open_ = open_.select("q").join(known, "q", "left").filter(F.coalesce("sure", F.lit(0)) < need)
        open_ = written(open_.select("q", F.when(F.col("met") >= need, F.col("far")).otherwise(bits).alias("bound")), "mih-open")
        dropped(*(x for x in before if hasattr(x, "_quarrylight_path")))
        if open_.isEmpty():
            break

    rows = best.select("q", "code", "distance").join(codes, "code").select("q", "distance", F.explode("ids").alias("id"))
    rows = rows.withColumn("at", nearest).filter(F.col("at") <= k)
    lists = written(rows.groupBy("q").agg(F.collect_list(F.struct("at", "id", "distance")).alias("near")), "mih-lists")  # k a query
    out = spread_join(asked, lists, "q", rows=max(1, 400_000 // k)).select(F.col("id").alias("query_id"), F.explode("near").alias("x"))
    return out.select("query_id", F.col("x.at").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by the signs of the 64 elements, of every row whose id is divisible by 50."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return hamming_topk(base, base.filter(F.col("id") % 50 == 0), k=10)


OP10_SQL = """
WITH bits AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(hamming(q.code, b.code) AS INTEGER) AS distance
  FROM bits q, bits b WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
