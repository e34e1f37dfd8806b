"""Byte-level BPE with a lexicon of frequent words.

Text is cut by the byte-level pattern of the tokenizer file (GPT-2's). The ids of frequent words come from a minimal
acyclic transducer (transducer.py) that every worker maps into memory; other words are merged exactly, by the file's own
merge list, with the tokenizers library's BPE model.

Which words are frequent is counted over all texts: a task reports the words that make up at least ``share`` of its own
words, and the reports are added up. A word with at least ``share`` of all words has it in at least one task, so no
such word is missed, and a task reports at most 1 / share words.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import chunks, given_back, put_bytes, tidy, with_struct, written
from .transducer import Lexicon, compile_lexicon

#: Unicode White_Space, as the tokenizer's \s; Python's own \s has four control characters more.
_WS = r"\t-\r \x85\xa0  -     　"
#: A word with the space before it, or a run of white space: pieces of the full pattern never cross these.
_WORD = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The byte-level pattern, for the inside of words.
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Letters with ASCII punctuation behind them.
_PUNCTUATED = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~]+)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """The model of a byte-level BPE tokenizer file: exact ids by merging, and back to bytes."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        alphabet = byte_alphabet()
        self.alphabet = {b: ord(c) for c, b in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.model = Tokenizer.from_str(tokenizer_json).model
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]
        self.pieces = regex.compile(_PIECE_PATTERN).findall
        self.special_starts = {t[0] for t in self.special}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece of the pattern: its bytes, merged pair by pair in the order of the merge list."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def word(self, word: str) -> list[int]:
        """The ids of one word or run of white space."""
        if word.isalpha() or word[1:].isalpha() and word[0] == " ":
            return self.merge(word)
        return [i for piece in self.pieces(word) for i in self.merge(piece)]


class Words(dict):
    """From a word to its ids, packed as little-endian integers; by lexicon or merging, with a bounded memo of recent words."""

    def __init__(self, encoder: BytePairEncoder, lexicon: Lexicon | None, bound: int = 400_000):
        super().__init__()
        self.encoder, self.lexicon, self.bound = encoder, lexicon, bound
        self.dtype, self.code = ("<u2", "H") if len(encoder.bytes_of) <= 1 << 16 else ("<u4", "I")

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def ids(self, word: str) -> list[int]:
        found = self.lexicon.get(word.encode()) if self.lexicon is not None else None
        return self.encoder.word(word) if found is None else found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        if (m := _PUNCTUATED.fullmatch(word)) and m[1].strip(" ").isalpha():  # the pattern parts letters from what follows
            found = self[m[1]] + self[m[2]]
        else:
            found = self.pack(self.ids(word))
        if len(word) <= 64:
            self[word] = found
        return found

    def packed(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        packed = []
        starts = self.encoder.special_starts
        parts = self.encoder.specials.split(text) if any(c in text for c in starts) else [text]
        for i, part in enumerate(parts):  # texts and special tokens in turn
            packed.append(self.pack([self.encoder.special[part]]) if i % 2 else b"".join(map(self.__getitem__, _WORD.findall(part))))
        return np.frombuffer(b"".join(packed), dtype=self.dtype)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def raw(self, ids: list[int]) -> bytes:
        """The bytes of ids as UTF-8, special tokens included, malformed parts replaced."""
        return _text(b"".join(map(self.encoder.bytes_of.__getitem__, ids)))

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode()

    def digest(self, text: str) -> tuple[int, str, str, np.ndarray]:
        """(number of ids, sha256 of the decimal ids, sha256 of the text decoded from them, the ids)."""
        packed = self.packed(text)
        ids = packed.tolist()
        decimal = b",".join(map(self.encoder.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(self.raw(ids)).hexdigest(), packed


def _text(raw: bytes) -> bytes:
    """raw as valid UTF-8, malformed parts replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def frequent_words(documents: DataFrame, share: float = 1 / 20_000) -> list[str]:
    """The words with at least ``share`` of all words of text, in ascending order of their bytes; at most 1 / share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = pruned = 0
        for batch in chunks(batches):
            for text in batch.column("text"):  # one at a time is turned into a string
                if text := text.as_py():
                    words = _WORD.findall(text)
                    total += len(words)
                    seen.update(words)
            while len(seen) > 400_000:  # lossy counting: what is dropped had less than the share so far
                pruned += 1
                seen = Counter({w: n for w, n in seen.items() if n > pruned})
        kept = [(w, n + pruned) for w, n in seen.items() if n + pruned >= share * total and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept] + [None], pa.string()), pa.array([n for _, n in kept] + [total], pa.int64())], ["word", "n"])

    sums = documents.select(F.col("text").cast("string")).mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    sums = written(sums, "word-counts")
    total = sums.filter(F.col("word").isNull()).select("n").first()
    if total is None or not total["n"]:
        return []
    rows = sums.filter(F.col("word").isNotNull() & (F.col("n") >= share * total["n"])).select("word").collect()  # at most 1 / share
    return sorted((r["word"] for r in rows), key=str.encode)


def build_lexicon(words: list[str], encoder: BytePairEncoder) -> bytes:
    return compile_lexicon((w.encode(), encoder.word(w)) for w in words)


def encode_documents(documents: DataFrame, tokenizer_path: str, share: float = 1 / 20_000, with_ids: bool = False, memo: int = 400_000) -> DataFrame:
    """documents plus n_tokens, ids_sha256, decoded_sha256[, ids array<int>]; columns of these names are replaced, others kept.

    The lexicon is counted, compiled on the driver (at most 1 / share words) and written to the shared folder, from where
    Spark hands every executor a copy to map. Null texts count as empty: no ids, the digests of nothing. Every row is coded by
    itself and whole, so ties, repeated rows and very long texts need no rule; an empty table gives an empty result. Which
    words are frequent changes no result, only what the lexicon answers; nor does ``memo``, the words whose ids a worker keeps.
    """
    import uuid

    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    lexicon = build_lexicon(frequent_words(documents, share), BytePairEncoder(spec))
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = put_bytes(spark, lexicon, name)
    spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(spec)  # the tokenizer file

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids + ">"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(BytePairEncoder(shared.value), Lexicon(SparkFiles.get(name)), memo)
        given_back()  # what reading the tokenizer file took
        for texts in batches:
            for at in range(0, len(texts), 256):  # small pieces: ids take several times the room of their text
                yield _coded([words.digest(text.as_py() or "") for text in texts[at : at + 256]], with_ids)  # one text at a time is turned into a string

    coded = tidy(run)  # the encoder and its memo are large
    coded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return with_struct(documents, F.arrow_udf(coded, kind)(F.col("text").cast("string")), ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])


def _coded(rows: list[tuple[int, str, str, np.ndarray]], with_ids: bool) -> pa.StructArray:
    """What digest gives of several texts, as encode_documents' struct."""
    n, ids_sha256, decoded_sha256, packed = zip(*rows, strict=True)
    columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha256, pa.string()), "decoded_sha256": pa.array(decoded_sha256, pa.string())}
    if with_ids:
        ends = np.cumsum([0, *n], dtype=np.int64)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(packed).astype(np.int32)))
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(documents, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
