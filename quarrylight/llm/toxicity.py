"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic function of hashed word features; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known; the gradient of the document loss flows through the noisy-or to the
sentences, so training finds the offending ones by itself, and ``score`` can point at them afterwards.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import crc_mod, with_struct

_NOT_WORD = re.compile(r"[\W_]+")
#: A sentence ends at one of these followed by white space, or at a line break.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


@dataclass
class ToxicityModel:
    """bits: log2 of the hashed feature space; weights: one per feature; bias: of every sentence."""

    bits: int
    weights: np.ndarray
    bias: float


def word_features(word: str, bits: int) -> list[int]:
    """The word itself and its beginnings of four to six letters, which inflected forms share."""
    mask = (1 << bits) - 1
    stems = {f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k}
    return [zlib.crc32(x.encode()) & mask for x in (word, *sorted(stems))]


def words(sentence: str) -> set[str]:
    """The distinct lower-cased words of a sentence, without digits' or letters' neighbours."""
    return set(_NOT_WORD.sub(" ", sentence.lower()).split())


class WordWeights(dict):
    """The weight of each word; holds a bounded number of the words met so far."""

    def __init__(self, model: ToxicityModel, bound: int = 400_000):
        super().__init__()
        self.model, self.bound = model, bound

    def __missing__(self, word: str) -> float:
        if len(self) >= self.bound:
            self.clear()
        w = self[word] = float(self.model.weights[word_features(word, self.model.bits)].sum())
        return w

    def sentence(self, text: str) -> float:
        """The log odds of one sentence."""
        return sum(map(self.__getitem__, words(text))) + self.model.bias

    def document(self, text: str | None) -> tuple[float, list[float]]:
        """The document's probability by noisy-or and its sentences' own."""
        each, clean = [], 1.0
        for s in sentences(text):
            z = self.sentence(s)
            p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
            each.append(p)
            clean *= 1 - p
        return 1 - clean, each


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s]


def train(texts: list[str], labels: list[int], bits: int = 18, epochs: int = 200, rate: float = 0.3, l2: float = 2e-5, least_documents: int = 6, deviations: float = 5.0) -> ToxicityModel:
    """Fits by full-batch adaptive gradient steps on the noisy-or log loss.

    Features of fewer than ``least_documents`` training documents, and those whose share of toxic documents is within
    ``deviations`` standard deviations of the mean, keep a weight of 0: labels are noisy, and such features would only
    learn documents by heart. Without documents of both classes every score is low."""
    memo: dict[str, list[int]] = {}
    feature, sentence_of, doc_of, n_sentences = array("i"), array("i"), array("i"), 0
    y = np.asarray(labels, dtype=np.float64)
    in_documents, in_toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    for d, text in enumerate(texts):
        seen_here: set[int] = set()
        for s in sentences(text):
            found = set()
            for w in words(s):
                if w not in memo:
                    memo[w] = word_features(w, bits)
                found.update(memo[w])
            seen_here |= found
            feature.extend(found)
            sentence_of.extend([n_sentences] * len(found))
            doc_of.append(d)
            n_sentences += 1
        at = np.fromiter(seen_here, dtype=np.int64, count=len(seen_here))
        in_documents[at] += 1
        in_toxic[at] += y[d] > 0
    feature, sentence_of, doc_of = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, np.int32) for x in (feature, sentence_of, doc_of))
    n = len(y)
    w, b = np.zeros(1 << bits), -5.0
    if not n_sentences or y.sum() < 1 or n - y.sum() < 1:
        return ToxicityModel(bits, w.astype(np.float32), b)
    expected = in_documents * y.mean()
    telling = np.abs(in_toxic - expected) >= deviations * np.sqrt(expected * (1 - y.mean()) + 1e-9)
    kept = (telling & (in_documents >= least_documents))[feature]
    feature, sentence_of = feature[kept], sentence_of[kept]
    seen, seen_b = np.full(1 << bits, 1e-10), 1e-10
    for _ in range(epochs):
        z = np.clip(np.bincount(sentence_of, weights=w[feature], minlength=n_sentences) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=n))
        bag = np.clip(1 - clean, 1e-3, 1)  # bounds the pull of a document without any sign, as mislabelled ones are
        # d loss / d z of a sentence: y=0 gives p, y=1 gives -p * clean / bag.
        g = np.where(y[doc_of] > 0, -p * clean[doc_of] / bag[doc_of], p) / n
        gw = np.bincount(feature, weights=g[sentence_of], minlength=1 << bits) + l2 * w
        gb = g.sum()
        seen += gw * gw
        seen_b += gb * gb
        w -= rate * gw / np.sqrt(seen)
        b -= rate * gb / np.sqrt(seen_b)
    return ToxicityModel(bits, w.astype(np.float32), float(b))


def sample_and_train(documents: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> ToxicityModel:
    """Fits on at most about ``sample_rows`` labelled rows, as many of them toxic as among all labelled rows.

    The rows are those with the smallest hashes of their id, the same fraction of both classes, so that the bias and a
    threshold mean the same at every size; whole texts are used, in the order of the hashes, whatever the files' layout.
    Rows with a null label or text are left out; a document with labels in several rows counts once, toxic if any says so.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(marks.count(), 1))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # about sample_rows ids: a bounded broadcast, so that the texts stay where they are
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = sorted(rows.select(F.xxhash64("doc_id").alias("rank"), "text", "toxic").toLocalIterator(), key=lambda r: (r["rank"], r["text"]))  # about sample_rows
    return train([r["text"] for r in found], [int(r["toxic"] > 0) for r in found])


def score(documents: DataFrame, model: ToxicityModel, locate: bool = False, threshold: float = 0.5) -> DataFrame:
    """documents plus score (0 to 1) and, with ``locate``, sentences: array<struct<sentence, score>> of those at or above threshold.

    Null and empty texts, and texts without words, score 0 or the bias alone; other columns pass through unless named
    score or sentences, which are replaced. Every row is scored by itself, so ties, repeated rows and an empty table need no
    rule; a very long text is scored whole, sentence by sentence.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**bits float32 weights: 1 MB at 18 bits
    kind = "struct<score:double,sentences:array<struct<sentence:string,score:double>>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordWeights(shared.value)
        for series in batches:
            scores, found = [], []
            for text in series:
                total, each = memo.document(text)
                scores.append(total)
                found.append([{"sentence": s, "score": p} for s, p in zip(sentences(text), each, strict=True) if p >= threshold] if locate else [])
            yield pd.DataFrame({"score": scores, "sentences": found})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return with_struct(documents.drop("score", "sentences"), F.pandas_udf(run, kind)(F.col("text")), ["score", "sentences"] if locate else ["score"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels of documents whose crc32 modulo 5 is not 0."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sample_and_train(documents, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0))
    scored = score(documents, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
