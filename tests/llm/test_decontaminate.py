import random
import re

import pytest

from quarrylight.llm.decontaminate import contamination, keep_clean

DOCS, ITEMS = "doc_id bigint, text string, items string, n_words int", "item_id bigint, text string, doc_id int"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window):
    w, hit, named = tokens(text), set(), set()
    for item_id, t in items:
        v = tokens(t)
        for i in range(max(len(v) - window, 0) + 1 if v else 0):
            x = v[i : i + window]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    named.add(str(item_id))
    return len(w), len(hit), sorted(named)


def data():
    r = random.Random(3)
    vocabulary = ["the", "The", "of", "été", "Été", "42", "x"]
    text = lambda a, b: r.choice([" ", ", ", "-"]).join(r.choices(vocabulary, k=r.randint(a, b)))
    items = [(i, text(1, 12)) for i in range(25)] + [(98, None), (99, ""), (100, "the of"), (101, "solo"), (102, "the of")]
    docs = [(i // 2, text(0, 60)) for i in range(150)] + [(None, "the of the of"), (None, None), (7, None), (8, ""), (9, "solo"), (9, "solo"), (10, "the of " * 3000)]
    return docs, items


@pytest.mark.parametrize("window,limit", [(4, 50_000), (4, 0), (10, 50_000)])
def test_equals_brute_force(spark, window, limit):
    docs, items = data()
    out = contamination(spark.createDataFrame([(*d, None, 1) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS), window, list_limit=limit)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect())
    assert got == sorted((-1 if d is None else d, *brute(t, items, window)) for d, t in docs)


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame([(1, "a b c d", None, 1), (2, "q a b c", None, 1), (3, None, None, 1)], DOCS)
    items = spark.createDataFrame([(5, "a b c", 1)], ITEMS)
    assert [r.n_hit for r in contamination(docs, items.limit(0)).collect()] == [0, 0, 0]
    assert contamination(docs.limit(0), items).collect() == []
    kept = keep_clean(docs, spark.createDataFrame([(5, "q a", 1)], ITEMS))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_clashing_names_and_repeated_ids(spark):
    """Columns named as the operator's own are kept, and rows of one id are judged each by its text."""
    item = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, item, 5, 6, 7), (1, "clean text here", 8, 9, 10), (None, f"x {item}", 1, 1, 1), (2, None, 2, 3, 4)], "doc_id bigint, text string, _id int, _hash int, text_hash int")
    kept = keep_clean(df, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == df.columns and sorted((r["_id"], r["_hash"], r.text_hash) for r in kept.collect()) == [(2, 3, 4), (8, 9, 10)]
