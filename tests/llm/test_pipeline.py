import math
import random

import corpus_pipeline
from pyspark.sql import types as T

from quarrylight.llm import langid
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as grouped
from tests.llm.test_secrets import brute as secret_spans


def corpus():
    r = random.Random(11)
    words = {"en": "the and of with that water house river stone green".split(), "de": "der und mit dass wasser haus fluss stein grün über".split()}
    text = lambda lang, n: " ".join(r.choices(words[lang], k=n)) + "."
    rows = [(i, text("en" if i % 3 else "de", r.randint(5, 80)), "en" if i % 3 else "de") for i in range(60)]
    rows += [(60, rows[3][1], "en"), (61, rows[4][1] + " extra", "en"), (62, None, None), (63, "", "en"), (64, "12345 !!! 678", "en")]
    rows += [(65, "жил был кот " * 60, None), (66, "the river token = abcdef123456 and stone", "en"), (67, rows[5][1] + " alpha beta gamma delta epsilon zeta eta theta iota kappa", "de")]
    rows += [(68, "the river and the stone of that house with water", None), (69, "ok", "en"), (70, " ".join(r.choices(words["en"], k=40_000)), "en")]
    rows += [(7, text("de", 33), "de"), (7, rows[7][1], "en"), (None, text("en", 21), "en")]  # an id of two texts, a repeated row, no id
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]


def test_stages_and_run(spark, tmp_path):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
    rows = corpus()
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa!"), (2, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    parser = langid.CrossParser(langid.learn(langid.training_rows(docs)))
    judged = [(r, parser.predict(r[1])) for r in rows]
    expected = [r for r, (lang, _, bits) in judged if lang != "und" and bits <= corpus_pipeline.FOREIGN_BITS + corpus_pipeline.MARGIN_BITS / math.sqrt(len(r[1]))]
    found = {r[1]: lang for r, (lang, _, _) in judged}
    ids = lambda rows: sorted(-1 if r[0] is None else r[0] for r in rows)
    assert {62, 63, 64, 65}.isdisjoint(ids(expected)) and set(ids(expected)) >= {*range(62), 68, 69, 70}
    assert ids(kept.collect()) == ids(expected)
    order = sorted(range(len(expected)), key=lambda i: (expected[i][0] is None, expected[i][0] or 0))
    number = {i: n for n, i in enumerate(order)}
    groups = {d: c for d, _, c in grouped([(number[i], r[1]) for i, r in enumerate(expected)], 5, 4, 5)}
    expected = [r for i, r in enumerate(expected) if groups[number[i]] == number[i]]
    expected = [r for r in expected if not contaminated(r[1], items, 10)[1]]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert ids(final) == ids(expected) and not {60, 67} & set(ids(final)) and 66 in ids(final) and ids(final).count(7) == 2
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text, lang, source, _ in expected:
        lang = lang or found[text]
        for a, _, b in reversed(secret_spans(text)):
            text = text[:a] + "[SECRET]" + text[b:]
        want.append((-1 if d is None else d, t.encode(text, add_special_tokens=False).ids, lang, source))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, r.lang, r.source) for r in final) == sorted(want)


def test_each_text_is_judged_once(spark):
    """The filter on what was found reads it, and does not parse every text a second time."""
    docs = spark.createDataFrame([(1, "the river and the stone", "en", "s", 23), (2, None, None, "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = corpus_pipeline.language_id(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    empty.selectExpr("doc_id as item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
