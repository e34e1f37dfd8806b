"""Token ids in a compact binary file format, written and read by Spark.

A token file is a folder of two Parquet tables, so that Spark's committers make writing safe against lost executors and
any store that Spark reads can hold it:

* ``codebook``: symbol, length: the canonical Huffman code, from counts over all ids;
* ``blocks``: independent blocks of consecutive documents: ``part`` and ``seq`` (order of the blocks), ``start`` (ids
  before the block within its part), ``n_tokens``, and as little-endian binaries ``doc_ids`` (int64), ``sizes`` (uint32,
  ids of each document), ``offsets`` (uint32, first byte of each document's stream), ``marks`` (uint32, bit-offset
  checkpoints) and ``data`` (the streams).

Blocks are in ascending order of doc_id, by (part, seq). A block can be decoded knowing the codebook alone.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from unicodedata import is_normalized
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .bpe import byte_alphabet
from .common import chunks, dropped, fresh_path, written
from .huffman import Codec, code_lengths


#: Unicode White_Space.
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Letters with ASCII punctuation behind them.
_PUNCTUATED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


class WordCache(dict):
    """The ids, as little-endian bytes, of pieces of text that the tokenizer encodes independently of their neighbours."""

    def __init__(self, tokenizer_path: str, bound: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(tokenizer_path), bound
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = {b: ord(c) for c, b in byte_alphabet().items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

    def ids(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        if piece.isalpha():
            ascii_only = piece.isascii()
            if piece.islower() and (ascii_only or is_normalized("NFC", piece)):
                # nothing left to normalise or to part: the library's model reads the bytes as they are
                plain = piece if ascii_only else piece.encode().decode("latin-1").translate(self.alphabet)
                found = self.pack([t.id for t in self.model.tokenize(plain)])
            elif ascii_only:  # the tokenizer lower-cases; beyond ASCII its rule is its own
                found = self[piece.lower()]
            else:
                found = self.ids(piece)
        elif (m := _PUNCTUATED.fullmatch(piece)) and m[1].isalpha():  # it parts letters from what follows
            found = self[m[1]] + self[m[2]]
        else:
            found = self.ids(piece)
        if len(piece) <= 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The tokenizer's ids of text. White space parts words before anything else here, so each word is looked up
        by itself; only a text that holds a special token is passed on as a whole."""
        for s in self.special:
            if s in text:
                return self.ids(text)
        # str.split() also parts at four control characters that are no white space to the tokenizer
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join(map(self.__getitem__, _WHITE.split(text) if odd else text.split()))


_CACHES: dict[str, WordCache] = {}


def word_cache(tokenizer_path: str) -> WordCache:
    if tokenizer_path not in _CACHES:
        _CACHES[tokenizer_path] = WordCache(tokenizer_path)
    return _CACHES[tokenizer_path]


def token_ids(documents: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids binary) of every row: the ids of its whole text, null counting as empty, then end_id. Every row is coded by
    itself and whole, so repeated rows, very long texts and an empty table need no rule; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], dtype=cache.dtype).tobytes()
        for batch in chunks(batches):
            ids = [cache.encode(t or "") + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids binary")


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in one array, and the length of each value in items of ``width`` bytes."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends) // width


def write_token_file(tokens: DataFrame, path: str, item: str = "<u2", block_tokens: int = 1 << 18, partitions: int | None = None) -> None:
    """Writes (doc_id, ids binary) rows, ids being items of numpy type ``item``, as a token file in ascending doc_id order.

    Documents with the same id stand together, ordered by their ids' bytes; a null id comes first. An empty input gives a
    file without blocks."""
    spark = tokens.sparkSession
    width = np.dtype(item).itemsize

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            data, _ = _flat(batch.column("ids"), width)
            seen = np.bincount(data.view(item))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["symbol", "n"])

    totals = tokens.select("ids").mapInArrow(count, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # a vocabulary at most
    counts = np.zeros(max((r["symbol"] for r in totals), default=0) + 1, dtype=np.int64)
    for r in totals:
        counts[r["symbol"]] = r["n"]
    lengths = code_lengths(counts)
    book = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part, seq, start = Codec(lengths), TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held, rows
            sizes = np.array([len(raw) // width for _, raw in rows], dtype=np.int64)
            data, at, marks = codec.encode(np.frombuffer(b"".join(raw for _, raw in rows), dtype=item), sizes)
            # a null id is written as the smallest integer
            doc_ids = np.array([-(1 << 63) if i is None else i for i, _ in rows], dtype="<i8")
            out = [part, seq, start, held, doc_ids.tobytes(), sizes.astype("<u4").tobytes(), at[:-1].astype("<u4").tobytes(), marks.astype("<u4").tobytes(), data]
            seq, start, held, rows = seq + 1, start + held, 0, []
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, out, strict=True))], schema=BLOCK)

        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                rows.append(row)
                held += len(row[1]) // width
                if held >= block_tokens:
                    yield flush()
        if rows:
            yield flush()

    dealt = tokens.repartitionByRange(partitions, "doc_id") if partitions else tokens.repartitionByRange("doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "sizes", "offsets", "marks", "data")]])
BLOCK_DDL = "part int, seq int, start bigint, n_tokens bigint, doc_ids binary, sizes binary, offsets binary, marks binary, data binary"


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document, decoded from the file alone."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # a vocabulary at most
    lengths = np.zeros(max((r["symbol"] for r in book), default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r["symbol"]] = r["length"]
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per written partition
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t).astype(np.int64)  # noqa: B023, E731
                n = get("sizes", "<u4")
                ids = codec.decode(batch.column("data")[row].as_py(), get("offsets", "<u4"), n, get("marks", "<u4"))
                cut = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:])]
                doc_ids = get("doc_ids", "<i8")
                start = before[batch.column("part")[row].as_py()] + batch.column("start")[row].as_py() + cut[:-1]
                columns = [pa.array(doc_ids, mask=doc_ids == -(1 << 63)), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in a token file, read back from it."""
    import public_tokenizers

    tokens = written(token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2), "tokens")
    path = fresh_path(spark, "tokenfile")
    write_token_file(tokens, path)
    dropped(tokens)
    return read_token_file(spark, path)
