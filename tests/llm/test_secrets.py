import random
import re

import pytest

from quarrylight.llm.secrets import BASE_RULES, RULES, Rule, redact, scan, trigram_query

SCHEMA = "doc_id bigint, text string, secret_spans int, rules string"
PIECES = [
    "password", "PassWord=", "token: ", "secret", "api_key='", "APIKEY = ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é😀", " ", "\n", ":", "=", '"', "x", "abc",
    "ghp_", "q" * 36, "xoxb-", "AIza", "eyJ", ".eyJ", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "the ", "/", "K",
]


def brute(text, rules=RULES):
    spans = [
        (m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least
    ]
    return sorted(spans)


def rows():
    r = random.Random(5)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(400)]
    return [(i // 2, t, 1, "x") for i, t in enumerate([*texts, None, "", None, "token=abcdefg " * 400])] + [(None, "password=hunter22", None, None)] * 2


@pytest.mark.parametrize("limit", [10_000, 0])
def test_spans_equal_brute_force(spark, limit):
    data = rows()
    out = scan(spark.createDataFrame(data, SCHEMA), broadcast_rows=limit)
    assert out.columns == ["doc_id", "text", "rules", "secret_spans"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.secret_spans]) for r in out.collect()), key=key)
    assert got == sorted(((d, t, brute(t)) for d, t, *_ in data), key=key)


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_queries():
    assert trigram_query("[0-9a-f]+") is None
    assert trigram_query("abc|abd") == [["abc"], ["abd"]]
    assert trigram_query("ab?cd") == [["abc", "bcd"], ["acd"]]
    assert trigram_query("(?i:Secret)x*") == [["cre", "ecr", "ret", "sec"]]
    assert trigram_query("foo(bar)+[a-z]*quux") == [["bar", "foo", "qux", "quu", "uux"]] or len(trigram_query("foo(bar)+[a-z]*quux")) == 1
    assert [r.kind for r in RULES if trigram_query(r.pattern) is None] == ["hex"]
    for t in (t for _, t, *_ in rows() if t):
        for r in RULES:
            q = trigram_query(r.pattern)
            if q and re.search(r.pattern, t):
                assert any(all(g in t.lower() for g in grams) for grams in q)


def test_redaction(spark):
    out = redact(spark.createDataFrame([(1, "a password=hunter22 b", 0, ""), (2, "clean", 0, ""), (3, None, 0, "")], SCHEMA)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a [SECRET] b", "clean", None]


def test_rule_without_index(spark):
    df = spark.createDataFrame([(1, "ab 123", 0, "")], SCHEMA)
    assert [tuple(s) for s in scan(df, [Rule("digits", "[0-9]+", least=2)]).first().secret_spans] == [(3, 0, 6)]
    assert len(BASE_RULES) == 3


def test_clashing_names(spark):
    """Columns named as the operator's own are kept."""
    df = spark.createDataFrame([(1, "token = abcdef123", 5, 6), (2, None, 7, 8)], "doc_id bigint, text string, _id int, _rules int")
    out = scan(df)
    assert out.columns == ["doc_id", "text", "_id", "_rules", "secret_spans"]
    assert sorted((r["_id"], r["_rules"], len(r.secret_spans)) for r in out.collect()) == [(5, 6, 1), (7, 8, 0)]
    assert [(r.text, r["_id"]) for r in redact(df).orderBy("doc_id").collect()] == [("[SECRET]", 5), (None, 7)]
