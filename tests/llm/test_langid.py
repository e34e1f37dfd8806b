import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm.langid import CrossParser, identify, learn, letters, phrases, suffix_automaton, training_rows

SCHEMA = "doc_id bigint, text string, lang string, score string"


def brute_phrases(sample, text):
    count = at = 0
    while at < len(text):
        n = 1
        count += text[at] not in sample  # an unknown character counts twice
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at] in sample:
            n += 1
        at += n
        count += 1
    return count


@given(st.text("abc ", max_size=40), st.text("abcd ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_parse_equals_brute_force(sample, text):
    assert phrases(suffix_automaton(sample), text) == brute_phrases(sample, text)
    assert phrases(suffix_automaton(sample), text, 3) >= min(4, brute_phrases(sample, text))


WORDS = {"aa": "kora mila tenu sava lopi rade".split(), "bb": "schtum grelb knorf wuggel pfrand".split(), "cc": "éta ùlo àri êne ïsa".split()}


def corpus(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang], k=r.randint(1, 30))), lang) for i, lang in ((i, r.choice(sorted(WORDS))) for i in range(n))]


def test_bounded_rivals_do_not_change_the_winner():
    parser = CrossParser({lang: " ".join(t for _, t, x in corpus(60, 1) if x == lang) for lang in WORDS})
    for _, text, lang in corpus(80, 2):
        full = [phrases(root, text) * parser.bits / len(text) for root in parser.roots]
        found, score, bits = parser.predict(text)
        assert found == lang == parser.languages[full.index(min(full))] and 0 <= score <= 1 and math.isclose(bits, min(full))


def test_table(spark):
    rows = [(i, t, lang if i % 4 else None, "x") for i, t, lang in corpus(300, 3)]
    rows += [(900, None, None, "x"), (901, "", "aa", "x"), (902, "123 !?", "bb", "x"), (None, "kora mila", "aa", None), (0, rows[0][1], None, "x"), (903, "kora " * 20_000, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    samples = learn(training_rows(df), chars_per_language=500, chars_per_row=50)
    assert set(samples) == set(WORDS) and all(len(s) <= 500 for s in samples.values())
    out = identify(df, samples)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_char"] and out.count() == len(rows)
    found = {r.doc_id: r for r in out.collect()}
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[902].score == 0 and found[903].lang_pred == "aa"
    truth = {i: lang for i, _, lang in corpus(300, 3)}
    assert sum(found[i].lang_pred == truth[i] for i in truth) == 300
    assert identify(df.limit(0), samples).collect() == [] and identify(df, learn(df.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_a_tiny_sample_wins_nothing():
    """A language known by one or two stray rows is not cheapest for the texts of others."""
    long = {lang: " ".join(t for _, t, x in corpus(200, 1) if x == lang) for lang in ("aa", "bb")}
    for tiny in ("q", "ok", "ra de"):
        parser = CrossParser(long | {"xx": tiny})
        assert all(parser.predict(t)[0] == lang for _, t, lang in corpus(80, 2) if lang != "cc")


def test_passages_come_from_all_of_a_row(spark):
    """Of long rows not the beginnings alone are learned."""
    rows = [(i, "kora " * 2000 + "tenu " * 2000, "aa", "x") for i in range(40)]
    sample = learn(spark.createDataFrame(rows, SCHEMA), chars_per_language=2000, chars_per_row=100)["aa"]
    assert "kora" in sample and "tenu" in sample


def test_languages_are_bounded(spark):
    rows = [(i, f"kora {lang}", lang, "x") for i, lang in enumerate(["aa"] * 5 + ["bb"] * 4 + [f"l{k:03d}" for k in range(30)])]
    assert set(learn(spark.createDataFrame(rows, SCHEMA), most_languages=3)) == {"aa", "bb", "l000"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "kora mila", "aa", 5, 6)], "doc_id bigint, text string, lang string, _made int, _made_ int")
    row = identify(df, {"aa": "kora mila tenu"}).first()
    assert (row["_made"], row["_made_"], row.lang_pred) == (5, 6, "aa")


def test_query_equals_brute_force(spark, tmp_path):
    """The query's predictions are those of a plain parse of every text against the same samples."""
    from quarrylight.llm.langid import UNDETERMINED, op1_language

    rows = [*((i, t, lang) for i, t, lang in corpus(120, 7)), (200, None, "aa"), (201, "12 34", None), (202, "", None), (203, "kora " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    samples = learn(training_rows(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    bits = math.log2(max(map(len, samples.values())) + 1)
    for r in op1_language(spark, str(tmp_path)).collect():
        plain = letters(dict((i, t) for i, t, _ in rows)[r.doc_id])
        if not plain:
            assert (r.lang_pred, r.score) == (UNDETERMINED, 0)
            continue
        cost = {lang: brute_phrases(s, plain) * bits / len(plain) for lang, s in samples.items()} if len(plain) < 1000 else None
        if cost:
            assert r.lang_pred == min(sorted(cost), key=cost.get) and math.isclose(r.bits_per_char, min(cost.values()))
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_letters():
    assert letters("Ab1c  d_é\n") == "ab c d é" and letters(None) == ""
