import random
import re

import pytest

from quarrylight.llm.components import components
from quarrylight.llm.jaccard import jaccard_components, keep_one

SCHEMA = "doc_id bigint, text string, n_shingles string, u int"


def shingles(text, k):
    w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def corpus(seed, groups=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = r.choices(vocabulary, k=40)
    out = []
    for g in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 4, 6, 9, 20, 60, 150]))
        if r.random() < 0.5:
            base = base + passage
        for _ in range(r.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 2)] = r.choices(vocabulary, k=r.randint(0, 2))
            out.append(" ".join(w))
    r.shuffle(out)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(out)]
    return rows + [(2000, None), (2001, ""), (2002, " \t "), (2003, "One two"), (2004, "one TWO"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v")]


@pytest.mark.parametrize("seed,k,num,den,rare,tile,limit", [(1, 4, 85, 100, 24, 1024, 10_000), (2, 4, 85, 100, 2, 8, 0), (3, 5, 4, 5, 3, 16, 10_000)])
def test_equals_brute_force(spark, seed, k, num, den, rare, tile, limit):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = jaccard_components(df, k, num, den, rare=rare, tile_rows=tile, broadcast_rows=limit)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
    assert got == brute(rows, k, num, den)


def test_empty_and_filter(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", "", 1), (2, "a b c d e f g", "", 1), (9, None, "", 1), (None, "x y", "", 1)], SCHEMA)
    assert jaccard_components(df.limit(0)).collect() == []
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 2, 9]


def test_repeated_ids(spark):
    """Rows are dropped by id and text: a unique text stays whatever other rows of its id do, and one of exact repeats stays."""
    x, y = "a b c d e f g h i j", "q r s t u v w x y z"
    df = spark.createDataFrame([(2, x, "", 1), (5, x, "", 2), (5, y, "", 3), (2, x, "", 4), (None, x, "", 5), (2, x + " ", "", 6), (7, None, "", 7), (7, None, "", 8)], SCHEMA)
    got = sorted((r.doc_id, r.text or "") for r in keep_one(df).collect())
    assert got in ([(2, t), (5, y), (7, ""), (7, "")] for t in (x, x + " "))
    assert keep_one(df.filter("doc_id is null")).count() == 1


def test_one_large_group_of_near_copies(spark):
    """A group of many blocks is one component, and a second group that shares its candidates stays apart."""
    r = random.Random(9)
    base, rest = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base) if i % 3 else base[:60] + rest
        w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)
    out = jaccard_components(df, 4, 85, 100, rare=4, tile_tokens=2000)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in out.collect())
    assert got == brute(rows, 4, 85, 100) and len({c for *_, c in got}) == 2


def test_very_long_texts_and_clashing_names(spark):
    r = random.Random(2)
    long = [f"w{r.randrange(50_000)}" for _ in range(120_000)]
    near = list(long)
    for i in range(0, 120_000, 4000):
        near[i] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:60_000]))]
    df = spark.createDataFrame([(*x, 4, 5, 6) for x in rows], "doc_id bigint, text string, _d int, text_hash int, node int")
    assert {(x.doc_id, x.component_id) for x in jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted((x.doc_id, x["_d"], x.text_hash, x.node) for x in kept.collect()) == [(1, 4, 5, 6), (3, 4, 5, 6)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150}
