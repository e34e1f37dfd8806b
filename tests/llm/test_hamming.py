import random

import pytest

from quarrylight.llm import hamming
from quarrylight.llm.hamming import hamming_topk, search_steps, segment_widths, sign_code

SCHEMA = "id bigint, code bigint, rank string"


def brute(base, queries, k):
    rows = sorted({(i, c) for i, c in base if i is not None and c is not None})
    out = []
    for q, code in queries:
        if q is not None and code is not None:
            near = sorted((bin((c ^ code) & (2**64 - 1)).count("1"), i) for i, c in rows)[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


def rows(seed, n, flips):
    r = random.Random(seed)
    centres = [r.getrandbits(64) - 2**63 for _ in range(5)]
    out = []
    for i in range(n):
        c = centres[i % 5] & (2**64 - 1)
        for _ in range(r.randint(0, flips)):
            c ^= 1 << r.randrange(64)
        out.append((i, c - 2**64 if c >= 2**63 else c))
    return out


@pytest.mark.parametrize("flips,most", [(3, 50_000), (60, 50_000), (20, 5)])
def test_equals_brute_force(spark, flips, most):
    base = rows(flips, 300, flips) + [(400 + i, 77) for i in range(100)]
    queries = base[::25] + [(1000, 77), (1001, -1)]
    dirty = [(*r, "x") for r in [*base, base[3], (None, 5), (500, None)]]
    out = hamming_topk(spark.createDataFrame(dirty, SCHEMA), spark.createDataFrame([(*q, "x") for q in queries], SCHEMA), 7, most_postings=most)
    assert sorted(map(tuple, out.collect())) == brute(base, queries, 7)


@pytest.mark.parametrize("flips", [0, 3, 20, 60])
def test_segment_by_segment(spark, flips):
    """Radii of many values are searched one segment at a time; queries may close between two."""
    base = rows(flips + 1, 300, flips)
    df = spark.createDataFrame([(*r, "x") for r in base], SCHEMA)
    assert sorted(map(tuple, hamming_topk(df, df.filter("id % 30 = 0"), 7, most_flips=8).collect())) == brute(base, base[::30], 7)


def test_steps():
    assert search_steps([3, 2], 3) == [(r, [0, 1]) for r in range(4)]
    assert search_steps([3, 2], 2) == [(0, [0, 1]), (1, [0]), (1, [1]), (2, [0]), (2, [1]), (3, [0, 1])]


def test_probes_are_not_broadcast(spark, monkeypatch):
    """A few open queries make very many probes, which the driver must not gather, though Spark takes them for few."""
    plans = []

    def kept(df, name, *more):
        if name == "mih-best":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, *more)

    written = hamming.written
    monkeypatch.setattr(hamming, "written", kept)
    df = spark.createDataFrame([(*r, "x") for r in rows(1, 300, 60)], SCHEMA)
    hamming_topk(df, df.filter("id % 50 = 0"), 3)
    assert plans and all("ShuffledHashJoin" in plan for plan in plans)


def test_small_and_empty(spark):
    two = spark.createDataFrame([(1, 0, "x"), (2, 3, "x")], SCHEMA)
    assert [tuple(r) for r in hamming_topk(two, two.filter("id = 1"), 5).orderBy("rank").collect()] == [(1, 1, 1, 0), (1, 2, 2, 2)]
    assert hamming_topk(two.limit(0), two, 3).collect() == [] and hamming_topk(two, two.limit(0), 3).collect() == []


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), ([float("nan"), None, 3.0],), (None,), ([-1.0] * 63 + [1.0],)], "v array<float>")
    assert [r[0] for r in df.select(sign_code("v")).collect()] == [9, 4, None, -(2**63)]


def test_segments():
    assert segment_widths(51_282, 64) == [13, 13, 13, 13, 12] and segment_widths(0, 64) == [1] * 64 and segment_widths(1 << 32, 64) == [32, 32]


def test_repeated_queries_and_clashing_names(spark):
    """Many queries of one code, columns named as the operator's own."""
    df = spark.createDataFrame([(i, 5 if i < 60 else i * 977, 1, 2) for i in range(100)], "id bigint, code bigint, q int, ids int")
    got = sorted(map(tuple, hamming_topk(df, df, 4).collect()))
    assert got == brute([(r.id, r.code) for r in df.collect()], [(r.id, r.code) for r in df.collect()], 4)
