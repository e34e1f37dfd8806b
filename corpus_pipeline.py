"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, secret redaction, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe, decontaminate, jaccard, langid, secrets
from quarrylight.llm.common import dropped, written
from quarrylight.tables import table

#: A text that costs more bits a character is in none of the languages: known letters in any order cost about log2(27),
#: letters that no sample holds twice the logarithm of a sample's length, about 30. The fewer characters, the wider the
#: margin of chance, which shrinks with the root of their number.
FOREIGN_BITS = 1.5 * math.log2(27)
MARGIN_BITS = 16.0
#: Words whose ids a BPE worker keeps: by then an executor's heap has grown to its limit and leaves little room beside it.
MEMO_WORDS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, without a letter, or unlike all learned ones by more than chance allows for so
    short a text. A row whose lang is null gets the language found. Rows are judged one by one and whole, so repeated rows
    and very long texts need no rule; an empty table stays empty, and without any labelled row all texts go."""
    judged = langid.identify(docs, langid.learn(langid.training_rows(docs)))
    limit = FOREIGN_BITS + MARGIN_BITS / F.sqrt(F.length("text"))
    kept = judged.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("bits_per_char") <= limit))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by 5-word shingles at a Jaccard similarity of 0.8; of rows with
    the same id and text one. Ids may repeat or be null; rows without words stay."""
    return jaccard.keep_one(docs, words=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs, each by its own text; null and empty texts stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. All rows stay, those with null or empty texts as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; a null text has none."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, memo=MEMO_WORDS)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("BPE encoding", bpe_encoding),
]

#: SQL cannot express the stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline{number}")
        if number:
            dropped(before)
    return docs
