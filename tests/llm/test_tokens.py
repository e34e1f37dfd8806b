import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import huffman, tokenfile
from quarrylight.llm.bpe import BytePairEncoder, Words, build_lexicon, encode_documents, frequent_words
from quarrylight.llm.transducer import Lexicon, compile_lexicon

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n", "a", "a  b", "a \n b", "it's  we'll\t\tDON'T", "x<|endoftext|>y <|startoftext|> z", "\x1ca\x1d\x1e b\x1f", "é é ́x",
    "naïve ÀÉ ß İ ſ", "汉字 かな", "a b c　d\u0085e", "123 4567 ½ ²", "!!! ??", "😀😀 ok", "w" * 5000, "ab" * 3000 + " x", "<|endoftext", "tail   ", "\r\n\r\n x", "﻿x ​ y",
]
SCHEMA = "doc_id bigint, text string, n_tokens string, extra int"


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@given(st.lists(st.integers(0, 9), max_size=300), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, parts):
    ids = np.array(ids, dtype=np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=10))
    cuts = np.linspace(0, len(ids), parts + 1).astype(np.int64)
    sizes = np.diff(cuts)
    codec = huffman.Codec(lengths)
    data, at, marks = codec.encode(ids, sizes)
    assert codec.decode(data, at[:-1], sizes, marks).tolist() == ids.tolist()


def test_huffman_lengths_are_limited_and_optimal():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array(fibonacci))
    assert lengths.max() == 16 and sum(2.0 ** -lengths.astype(float)) == 1
    assert huffman.code_lengths(np.array([5, 1, 1, 2, 0])).tolist() == [1, 3, 3, 2, 0]


def test_token_file_matches_the_library(spark, tmp_path):
    rows = [(i * 3 % 101, t, "x", 1) for i, t in enumerate(ODD * 4)] + [(None, "no id", None, None)]
    path = str(tmp_path / "f")
    tokens = tokenfile.token_ids(spark.createDataFrame(rows, SCHEMA), WORD, 2)
    tokenfile.write_token_file(tokens, path, block_tokens=500, partitions=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in tokenfile.read_token_file(spark, path, with_ids=True).collect())
    _, ids = library(WORD, [r[1] for r in rows])
    want = sorted((r[0] if r[0] is not None else -1, x + [2]) for r, x in zip(rows, ids))
    assert sorted((d if d is not None else -1, list(x)) for _, d, _, _, x in got) == want
    assert [d if d is not None else -1 for _, d, *_ in got] == [d for d, _ in want]
    at = 0
    for start, _, n, crc, x in got:
        assert (start, n) == (at, len(x)) and crc == zlib.crc32(np.array(x, "<u4").tobytes())
        at += n


def test_empty_token_file(spark, tmp_path):
    path = str(tmp_path / "f")
    tokenfile.write_token_file(tokenfile.token_ids(spark.createDataFrame([], SCHEMA), WORD, 2), path)
    assert tokenfile.read_token_file(spark, path).collect() == []


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 60000), max_size=4), max_size=60))
@settings(max_examples=100, deadline=None)
def test_transducer_maps_exactly_its_words(entries):
    lexicon = Lexicon(compile_lexicon(sorted(entries.items())))
    assert [lexicon.rank(w) for w in sorted(entries)] == list(range(len(entries)))
    for w, ids in entries.items():
        assert lexicon.get(w) == ids
        if w + b"\x00" not in entries:
            assert lexicon.get(w + b"\x00") is None


def test_transducer_shares_suffixes():
    words = sorted((a + b).encode() for a in "abcdef" for b in ("tion", "ing"))
    states = np.frombuffer(compile_lexicon((w, [1]) for w in words)[:8], "<i4")[1]
    assert states == 8  # start, one for all first letters, ion/io/n and in/i/g sharing the end


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(open(BYTE, encoding="utf-8").read())


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_bpe_equals_library(text):
    global _T, _W
    if "_T" not in globals():
        _T, enc = Tokenizer.from_file(BYTE), BytePairEncoder(open(BYTE, encoding="utf-8").read())
        _W = Words(enc, Lexicon(build_lexicon(sorted([" the", "a", "\n", " é"], key=str.encode), enc)))
    ids = _T.encode(text, add_special_tokens=False).ids
    assert _W.encode(text) == ids
    assert _W.decode(ids) == _T.decode(ids, skip_special_tokens=False)


def test_documents_equal_library(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD * 3)] + [(None, "no id", None, None)]
    t, ids = library(BYTE, [r[1] for r in rows])
    out = encode_documents(spark.createDataFrame(rows, SCHEMA), BYTE, share=0.01, with_ids=True)
    assert out.columns == ["doc_id", "text", "extra", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r, x in zip(out.orderBy(out.doc_id.asc_nulls_last()).collect(), ids):
        assert r.ids == x and r.n_tokens == len(x)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_words_and_empty_table(spark):
    df = spark.createDataFrame([(i, "the cat " + "the " * i, None, None) for i in range(20)], SCHEMA)
    assert " the" in frequent_words(df, 0.1) and frequent_words(df.limit(0)) == []
    assert encode_documents(df.limit(0), BYTE).count() == 0


def test_huffman_of_many_symbols():
    """More symbols than codes of 16 bits can name get longer codes."""
    r = np.random.default_rng(2)
    ids = np.concatenate([np.arange(70_000), r.integers(0, 40, 100_000)])
    lengths = huffman.code_lengths(np.bincount(ids))
    assert lengths.max() > 16 and abs(sum(2.0 ** -lengths[lengths > 0].astype(float)) - 1) < 1e-9
    codec, sizes = huffman.Codec(lengths), np.array([1, 0, 63, 64, 65, len(ids) - 193])
    data, at, marks = codec.encode(ids, sizes)
    assert (codec.decode(data, at[:-1], sizes, marks) == ids).all()


def test_special_tokens_of_any_form(encoder):
    """Special tokens are found whatever character they begin with."""
    words = Words(encoder, None)
    known, encoder.special = encoder.special, {"[END]": 7}
    starts, encoder.special_starts = encoder.special_starts, {"["}
    specials, encoder.specials = encoder.specials, re.compile(r"(\[END\])")
    try:
        assert words.encode("a[END]b") == [*words.encode("a"), 7, *words.encode("b")]
    finally:
        encoder.special, encoder.special_starts, encoder.specials = known, starts, specials


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "the river", 5, "x")], "doc_id bigint, text string, _made int, ids string")
    row = encode_documents(df, public_tokenizers.path("byte_bpe_50k.json")).first()
    assert (row["_made"], row.ids) == (5, "x") and row.n_tokens > 0


def test_encoding_with_little_memory(spark):
    """A worker turns one text at a time into a string, without pandas, and a memo that is often cleared changes no ids."""
    from pyspark.util import PythonEvalType

    texts = [" ".join(f"w{i}x{j}, é{j % 7}" for j in range(40)) for i in range(600)] + ODD
    coded = encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), BYTE, with_ids=True, memo=16)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n" in plan and plan.count("ArrowEvalPython") == 1
    assert [list(r.ids) for r in coded.orderBy("doc_id").collect()] == library(BYTE, texts)[1]
