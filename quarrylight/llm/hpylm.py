"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

A token's context is the token before it; the first of a document follows the end of one. Every word that precedes another
has a restaurant of its own; all share one parent, the restaurant without context, whose base is uniform over the known
words, the end and one unknown word. The tables of the contexts' restaurants are the parent's customers.

Seating is sampled by Gibbs sweeps over the numbers of tables. A dish's tables are drawn anew from their distribution given
all else: generalised Stirling numbers count the seatings of its customers, the restaurant's other tables and the parent's
other customers weigh each table more (``draw_tables``). From the ``EXACT``-th customer of a dish on, customers are seated
one after another, in blocks that grow with the dish. All dishes of a sweep are drawn side by side, given the sweep before.
The contexts' discount and strength are those under which training tokens, each left out in turn, are most likely.
Predictive probabilities are averaged over the sweeps after the first.

Distribution. Documents are coded in blocks of bounded size, against the block's own dictionary. Words belong to word shards
by their hash, pairs to pair shards by their context (a context of very many tokens by its words too), and the numbers of
both kinds of shards follow the bytes of text, so that a shard's size is bounded. Blocks and shards exchange messages: one
packed row for each two that have something to say to each other (``packing``).

1. blocks send their words and counts to the word shards, which number the words and answer with numbers and counts;
2. blocks send their distinct pairs as numbers to the pair shards, which add them up and answer with the sums;
3. each sweep, pair shards draw the tables of their pairs and tell the word shards, which add up tables by context and
   customers by word, draw the parent's tables and answer. A pair of one token has one table whatever is drawn, so only
   pairs of two or more take part; what single pairs add to a word is what the others leave of its tokens;
4. both kinds of shards tell the blocks the state of each kept sweep, and the blocks price their tokens.

The coded blocks are a table bucketed by block, so that they are not shuffled when messages meet them. Words are known by
64 bits of their hash; two would collide with negligible probability. What reaches the driver is a few numbers a sweep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import bucketed, chunks, crc_mod, dropped, written
from .packing import pack, pair_steps, pairs_of, steps, unpack

#: Stands for the end of a text among the words; no word holds white space.
END = "\n"
#: Customers of a dish whose seatings are counted exactly.
EXACT = 48
#: Bytes of text of a block; of text for each word shard and for each pair shard; tokens after which a context is split.
BLOCK_BYTES, WORD_SHARD_BYTES, PAIR_SHARD_BYTES, SPLIT_TOKENS = 12 << 20, 24 << 20, 12 << 20, 1 << 19
#: Among these (discount, strength) those of the contexts' restaurants are chosen.
CHOICES = [(float(d), float(s)) for d in np.arange(0.05, 1, 0.1) for s in np.geomspace(0.1, 10_000, 16)]


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] counts the seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        for t in range(1, c + 2):
            stay = np.log(c - discount * t) + out[c, t] if c > discount * t else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


@dataclass
class Parent:
    """The parent of a restaurant: its discount, strength, total customers and tables, and the base's share of a dish."""

    discount: float
    strength: float
    customers: float
    tables: float
    base: float

    def other(self, customers: np.ndarray, tables: np.ndarray, own: np.ndarray, more: int) -> np.ndarray:
        """Probability of a dish when ``own`` of its customers here are taken away and ``more`` have come back."""
        left = customers - own
        sits = np.maximum(np.minimum(tables, left), 1 if more else 0)
        mass = (self.strength + self.discount * self.tables) * self.base
        return (np.maximum(left + more - self.discount * sits, 0) + mass) / (self.strength + np.maximum(self.customers - own, 0) + more)


def draw_tables(count: np.ndarray, now: np.ndarray, total: np.ndarray, discount: float, strength: float, above, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with ``count`` customers, drawn given all else.

    now: their tables so far; total: all tables of each dish's restaurant; above(places, j): the parent's probability of
    the dishes at ``places`` for their j-th table (from 0), their own tables up to then counted."""
    out = (count > 0).astype(np.int64)
    log_seatings, other = stirling(discount), np.maximum(total - now, 0)
    chance = rng.random(len(count))
    few = np.minimum(count, EXACT)
    order = np.argsort(few, kind="stable")
    cuts = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    for c, a, b in zip(range(2, EXACT + 1), cuts[:-1], cuts[1:], strict=True):
        for at in range(a, b, 100_000):
            mine = order[at : min(b, at + 100_000)]
            weight = np.empty((len(mine), c))
            for j in range(c):
                weight[:, j] = np.log(strength + discount * (other[mine] + j)) + np.log(above(mine, j))
            weight = np.cumsum(weight, axis=1) + log_seatings[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[mine] = 1 + (chance[mine, None] * weight[:, -1:] > weight[:, :-1]).sum(axis=1)
    live = np.flatnonzero(count > EXACT)
    seated = np.full(len(live), EXACT, dtype=np.int64)
    price = above(live, 1)
    while len(live):
        block = np.minimum(np.maximum(1, seated // 16), count[live] - seated)
        new = (strength + discount * (other[live] + out[live])) * price
        out[live] += rng.binomial(block, new / (new + seated - discount * out[live]))
        seated = seated + block
        more = seated < count[live]
        live, seated, price = live[more], seated[more], price[more]
    return out


@dataclass
class Model:
    """kinds: known words and the end; the contexts' discount and strength; the parent's; (customers, tables) of the parent by sweep."""

    kinds: int
    parent_discount: float
    parent_strength: float
    discount: float = 0.5
    strength: float = 1.0
    sweeps: list[tuple[float, float]] = field(default_factory=list)

    def above(self, sweep: int) -> Parent:
        customers, tables = self.sweeps[sweep]
        return Parent(self.parent_discount, self.parent_strength, customers, tables, 1 / (self.kinds + 1))

    def parent(self, customers: np.ndarray | float, tables: np.ndarray | float, sweep: int) -> np.ndarray | float:
        """The parent's probability of a dish with so many customers and tables."""
        p = self.above(sweep)
        return (customers - p.discount * tables + (p.strength + p.discount * p.tables) * p.base) / (p.strength + p.customers)

    def draw_pairs(self, count, now, of_context, customers, tables, sweep: int, rng: np.random.Generator) -> np.ndarray:
        """Tables of pairs: of_context: all tables of their contexts; customers, tables: those of their words in the parent."""
        p = self.above(sweep)
        return draw_tables(count, now, of_context, self.discount, self.strength, lambda at, j: p.other(customers[at], tables[at], now[at], j), rng)

    def draw_words(self, customers, now, sweep_tables: float, rng: np.random.Generator) -> np.ndarray:
        """Tables of the parent's dishes."""
        total = np.full(len(customers), sweep_tables)
        return draw_tables(customers, now, total, self.parent_discount, self.parent_strength, lambda at, j: np.full(len(at), 1 / (self.kinds + 1)), rng)


def left_out(single: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Log probability of pairs seen once, each left out in turn, at each of CHOICES, but for the parent's part, the same at all."""
    (k, n, t), times = np.unique(np.stack([single, customers, tables]).astype(np.float64), axis=1, return_counts=True)
    n, t = np.maximum(n - 1, 0), np.maximum(t - 1, 0)
    return np.array([(times * k * np.log((s + d * t) / (s + n))).sum() for d, s in CHOICES])


def left_out_repeated(count: np.ndarray, customers: np.ndarray, tables: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The same of the tokens of pairs seen more than once, of one table each."""
    return np.array([(count * np.log((count - 1 - d + (s + d * tables) * above) / (s + customers - 1))).sum() for d, s in CHOICES])


BLOCKS = "block bigint, words binary, docs binary"
MESSAGES = "kind int, shard int, block bigint, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _held(messages: pa.Table, kind: int, key: str) -> list[tuple[int, list[np.ndarray]]]:
    """(key, arrays) of the messages of a kind, by ascending key."""
    mine = messages.filter(pc.equal(messages.column("kind"), kind))
    return sorted(((k, unpack(d)) for k, d in zip(mine.column(key).to_pylist(), mine.column("data").to_pylist(), strict=True)), key=lambda m: m[0])


def _code(rows: DataFrame) -> DataFrame:
    """Blocks of documents: words: the hashes of its words and the end, the most frequent first, and their training counts;
    docs: ids, whether known, held out, tokens of each, and the places of all tokens among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(chunks(batches, BLOCK_BYTES)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            ends = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            names, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            blank = pc.index(names, "").as_py() if len(names) else -1
            real = index != blank
            size = np.diff(np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]) + 1
            first = np.concatenate([[0], np.cumsum(size)])
            tokens = np.full(int(first[-1]), len(names), dtype=np.int32)  # the end has the last number
            is_word = np.ones(len(tokens), dtype=bool)
            is_word[first[1:] - 1] = False
            tokens[is_word] = index[real]
            seen = np.bincount(tokens, minlength=len(names) + 1)
            order = np.argsort(-seen, kind="stable")  # small numbers are common, and pack well
            order = order[seen[order] > 0]
            place = np.zeros(len(names) + 1, dtype=np.int32)
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            words = pa.concat_arrays([names.cast(pa.string()), pa.array([END])]).take(pa.array(order))
            hashes = hash_array(words.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
            del lists, coded, real, is_word, words
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(tokens[np.repeat(~held, size)], minlength=len(order))
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            docs = pack(ids.fill_null(0).to_numpy(), known.astype(np.int64), held.astype(np.int64), size, tokens)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([pack(hashes, counts)], pa.binary()), pa.array([docs], pa.binary())], ["block", "words", "docs"])

    return rows.mapInArrow(run, BLOCKS)


def _deal(shard_of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by shard, and where in it each shard's items stand."""
    order = np.argsort(shard_of, kind="stable")
    found, cuts = np.unique(shard_of[order], return_index=True)
    return order, [(int(s), slice(a, b)) for s, a, b in zip(found, cuts, [*cuts[1:], len(order)])]


def _send_words(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                hashes, n = unpack(data)
                order, parts = _deal((hashes.view(np.uint64) % np.uint64(shards)).astype(np.int64))
                yield from _rows([(0, s, block, pack(hashes[order[z]], n[order[z]])) for s, z in parts]).to_batches()

    return blocks.select("block", "words").mapInArrow(run, MESSAGES)


def _number_words(key: tuple, messages: pa.Table) -> pa.Table:
    """Of one word shard: kind 0: to each block, the ranks of its words among the shard's, from 1, 0 for one that is not
    learned, and their counts; kind 1: the counts by rank."""
    shard, said = key[0].as_py(), _held(messages, 0, "block")
    hashes, at = np.unique(np.concatenate([h for _, (h, _) in said]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([n for _, (_, n) in said]), minlength=len(hashes)).astype(np.int64)
    order = np.lexsort((hashes, -n))
    rank = np.zeros(len(n), dtype=np.int64)
    rank[order] = np.arange(1, len(n) + 1)
    rank[n == 0] = 0
    out, begin = [], 0
    for block, (h, _) in said:
        mine = at[begin : begin + len(h)]
        out.append((0, shard, block, pack(rank[mine], n[mine])))
        begin += len(h)
    out.append((1, shard, -1, pack(n[order][: int((n > 0).sum())])))
    return _rows(out)


class Block:
    """A block's documents and words."""

    def __init__(self, row: pa.Table):
        self.number = row.column("block")[0].as_py()
        self.hashes, _ = unpack(row.column("words")[0].as_py())
        self.ids, self.known, self.held, self.size, self.tokens = unpack(row.column("docs")[0].as_py())
        self.known, self.held = self.known.astype(bool), self.held.astype(bool)

    def places(self, said: list[tuple[int, list[np.ndarray]]], shards: int, column: int) -> np.ndarray:
        """What the word shards say of the words, by their place."""
        order = np.argsort((self.hashes.view(np.uint64) % np.uint64(shards)).astype(np.int64), kind="stable")
        out = np.zeros(len(order), dtype=np.int64)
        out[order] = np.concatenate([x[column] for _, x in said])
        return out

    def numbers(self, said: list[tuple[int, list[np.ndarray]]], shards: int) -> np.ndarray:
        """The words' numbers, from 1; 0 for those that are not learned."""
        rank = self.places(said, shards, 0)
        return np.where(rank > 0, (rank - 1) * shards + (self.hashes.view(np.uint64) % np.uint64(shards)).astype(np.int64) + 1, 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct pairs: place of the context, place of the word, training count; and the pair of each token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]  # a document's first token follows the end of the one before
        before[:1] = self.tokens[-1:]  # and the block's first the last end
        keys, pair = np.unique(before * len(self.hashes) + self.tokens, return_inverse=True)
        counts = np.bincount(pair[np.repeat(~self.held, self.size)], minlength=len(keys))
        return keys // len(self.hashes), keys % len(self.hashes), counts, pair


def _dealt_pairs(u: np.ndarray, w: np.ndarray, tokens_of_u: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of pairs of numbers by pair shard, u and w, without those that hold an unknown word; and the shards' places."""
    part = w % (1 + tokens_of_u // SPLIT_TOKENS)
    mixed = (u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(17)
    shard = (mixed % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((w, u, shard))
    order = order[(u[order] > 0) & (w[order] > 0)]
    _, parts = _deal(shard[order])
    return order, parts


def _by_shard(numbers: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Of words' numbers: place of each among the distinct ones as they are sent; their ranks, from 0; the word shards' places."""
    found, at = np.unique(numbers, return_inverse=True)
    order, parts = _deal((found - 1) % shards)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[at], (found[order] - 1) // shards, parts


class Pairs:
    """A pair shard's pairs of two or more tokens, and what it asks of the word shards and learns from them."""

    def __init__(self, data: bytes, word_shards: int):
        du, dw, self.n = unpack(data)
        self.u, self.w = pairs_of(du, dw)
        self.at_u, self.rank_u, parts_u = _by_shard(self.u, word_shards)
        self.at_w, self.rank_w, parts_w = _by_shard(self.w, word_shards)
        u, w, none = dict(parts_u), dict(parts_w), slice(0, 0)
        self.parts = [(p, u.get(p, none), w.get(p, none)) for p in sorted(u.keys() | w.keys())]

    def sums(self, shard: int, values: np.ndarray) -> list[tuple]:
        """Messages (kind 3) to the word shards: values and pairs, added up by context and by word."""
        add = lambda at, size, x: np.bincount(at, weights=x, minlength=size).astype(np.int64)
        nu, nw = len(self.rank_u), len(self.rank_w)
        of_u, of_w = add(self.at_u, nu, values), add(self.at_w, nw, values)
        pu, pw = np.bincount(self.at_u, minlength=nu), np.bincount(self.at_w, minlength=nw)
        return [(3, p, shard, pack(steps(self.rank_u[a]), of_u[a], pu[a], steps(self.rank_w[b]), of_w[b], pw[b])) for p, a, b in self.parts]

    def told(self, said: list[tuple[int, list[np.ndarray]]]) -> tuple[np.ndarray, ...]:
        """By pair: tokens and tables of the context, customers and tables of the word in the parent."""
        n, t_u, c, t = (np.concatenate([x[i] for _, x in said]) for i in range(4))
        return n[self.at_u], t_u[self.at_u], c[self.at_w], t[self.at_w]


def _merge_pairs(key: tuple, messages: pa.Table, word_shards: int) -> pa.Table:
    """Of one pair shard: kind 0: to each block, the sums of its pairs; kind 1: for each block, which of its pairs are
    repeated ones; kind 2: those, with their sums; kind 3: to the word shards."""
    shard, said = key[0].as_py(), _held(messages, 0, "block")
    size = [len(x[0]) for _, x in said]
    each = [pairs_of(du, dw) for _, (du, dw, _) in said]
    u, w, n = (np.concatenate(x) for x in ([u for u, _ in each], [w for _, w in each], [x[2] for _, x in said]))
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=n[order]).astype(np.int64)
    repeated = total > 1
    number = np.where(repeated, np.cumsum(repeated) - 1, -1)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = group
    out, begin = [], 0
    for (block, _), m in zip(said, size, strict=True):
        mine = at[begin : begin + m]
        begin += m
        out.append((0, shard, block, pack(total[mine])))
        out.append((1, shard, block, pack(steps(number[mine][repeated[mine]]))))
    first = np.flatnonzero(new)[repeated]
    data = pack(*pair_steps(u[first], w[first]), total[repeated])
    out.append((2, shard, -1, data))
    out += Pairs(data, word_shards).sums(shard, total[repeated])
    return _rows(out)


STATES = "kind int, shard int, block bigint, data binary, words bigint, tokens bigint, customers bigint, tables bigint, in_one bigint, in_two bigint"


def _state(shard: int, replies: list[tuple], arrays: tuple[np.ndarray, ...]) -> pa.Table:
    """Rows of a word shard after an exchange: kind 4: to the pair shards (shard is theirs, block this one's); kind 5: n, single
    pairs by context and by word, tables by context, customers and tables in the parent; with totals."""
    n, _, _, _, c, t = arrays
    rows = _rows([*replies, (5, shard, -1, pack(*arrays))])
    sums = [len(n), n.sum(), c.sum(), t.sum(), (c == 1).sum(), (c == 2).sum()]
    for name, x in zip(("words", "tokens", "customers", "tables", "in_one", "in_two"), sums, strict=True):
        rows = rows.append_column(name, pa.array([0] * len(replies) + [int(x)], pa.int64()))
    return rows


def _meet(key: tuple, state: pa.Table, messages: pa.Table, model: Model | None, sweep: int) -> pa.Table:
    """A word shard takes the pair shards' sums: of tokens at first (sweep 0, when each pair has one table), then of tables."""
    shard, said = key[0].as_py(), _held(messages, 3, "block")
    n, *before = unpack(state.column("data")[0].as_py())
    as_u, pairs_u, as_w, pairs_w = (np.zeros(len(n), dtype=np.int64) for _ in range(4))
    asked = []
    for source, (ru, su, pu, rw, sw, pw) in said:
        ru, rw = np.cumsum(ru), np.cumsum(rw)
        as_u[ru] += su
        pairs_u[ru] += pu
        as_w[rw] += sw
        pairs_w[rw] += pw
        asked.append((source, ru, rw))
    if sweep:
        single_u, single_w, _, _, now = before
        t_u, c = single_u + as_u, single_w + as_w
        t = model.draw_words(c, np.minimum(now, c), model.sweeps[-1][1], np.random.default_rng((2, sweep, shard)))
    else:
        single_u, single_w = n - as_u, n - as_w
        t_u, c, t = single_u + pairs_u, single_w + pairs_w, np.ones(len(n), dtype=np.int64)
    replies = [(4, source, shard, pack(n[ru], t_u[ru], c[rw], t[rw])) for source, ru, rw in asked]
    return _state(shard, replies, (n, single_u, single_w, t_u, c, t))


def _partitions(df: DataFrame, key: str, n: int) -> DataFrame:
    """By key; in a number of partitions that is not lowered for rows that look small but are costly."""
    return df.repartition(n, key)


def _choose(pair_states: DataFrame, replies: DataFrame, words: DataFrame, model: Model, word_shards: int, n: int) -> tuple[float, float]:
    """The discount and strength under which each training token, left out in turn, is most likely given the rest."""
    kind = "i int, x bigint"

    def rows(x: np.ndarray) -> pa.Table:  # rounded, so that the order of the sum is of no effect
        return pa.table({"i": pa.array(np.arange(len(x)), pa.int32()), "x": pa.array(np.rint(x * 1024).astype(np.int64))})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                n, single_u, _, t_u, _, _ = unpack(data)
                yield from rows(left_out(single_u, n, t_u)).to_batches()

    def repeated(state: pa.Table, said: pa.Table) -> pa.Table:
        mine = Pairs(state.column("data")[0].as_py(), word_shards)
        if not len(mine.n):
            return rows(np.zeros(0))
        customers, tables, c, t = mine.told(_held(said, 4, "block"))
        return rows(left_out_repeated(mine.n, customers, tables, model.parent(c, t, 0)))

    of_pairs = _partitions(pair_states, "shard", n).groupBy("shard").cogroup(_partitions(replies, "shard", n).groupBy("shard")).applyInArrow(repeated, kind)
    both = words.select("data").mapInArrow(single, kind).unionByName(of_pairs)
    found = {r["i"]: r["x"] for r in both.groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return CHOICES[max(range(len(CHOICES)), key=lambda i: (found.get(i, 0), -i))]


def fit_and_score(documents: DataFrame, sweeps: int = 3, strength: float = 1.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of documents.

    documents: doc_id, text, held_out boolean (null counts as false: learned from); other columns are ignored, whatever their
    names. Tokens are words parted by ASCII white space, A-Z lower-cased, and one end; a null text has only the end. Rows
    are scored one by one, so repeated rows and null ids need no rule, and a very long text is one block by itself; an empty
    table gives an empty result. If nothing is learned, every token is unknown. ``sweeps`` is at least 1; the states after
    the last two are averaged, or the only one; ``strength`` is the parent's.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards, pair_shards = 1 + n_bytes // WORD_SHARD_BYTES, 1 + n_bytes // PAIR_SHARD_BYTES
    in_words, in_pairs, in_blocks = (min(int(n), 20_000) for n in (word_shards, pair_shards, 1 + n_bytes // (2 * BLOCK_BYTES)))
    blocks = bucketed(_code(rows), "lm-blocks", ["block"], in_blocks)

    met = _partitions(_send_words(blocks, word_shards), "shard", in_words).groupBy("shard").applyInArrow(_number_words, MESSAGES)
    numbered = written(met, "lm-numbers")
    to_blocks = numbered.filter("kind = 0")

    def send_pairs(row: pa.Table, said: pa.Table) -> pa.Table:
        block, said = Block(row), _held(said, 0, "shard")
        number, count = block.numbers(said, word_shards), block.places(said, word_shards, 1)
        u, w, n, _ = block.pairs()
        order, parts = _dealt_pairs(number[u], number[w], count[u], pair_shards)
        u, w, n = number[u][order], number[w][order], n[order]
        return _rows([(0, s, block.number, pack(*pair_steps(u[z], w[z]), n[z])) for s, z in parts])

    sent = blocks.groupBy("block").cogroup(_partitions(to_blocks, "block", in_blocks).groupBy("block")).applyInArrow(send_pairs, MESSAGES)
    merged = _partitions(sent, "shard", in_pairs).groupBy("shard").applyInArrow(lambda key, t: _merge_pairs(key, t, word_shards), MESSAGES)
    merged = written(merged, "lm-pairs")
    pair_states = merged.filter("kind = 2")

    def exchange(state: DataFrame, messages: DataFrame, model: Model | None, sweep: int) -> DataFrame:
        grouped = _partitions(state, "shard", in_words).groupBy("shard").cogroup(_partitions(messages, "shard", in_words).groupBy("shard"))
        return written(grouped.applyInArrow(lambda key, a, b: _meet(key, a, b, model, sweep), STATES), "lm-words")

    def totals(state: DataFrame):
        return state.filter("kind = 5").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "customers", "tables", "in_one", "in_two")]).first()

    words = exchange(numbered.filter("kind = 1"), merged.filter("kind = 3"), None, 0)
    facts = totals(words)
    share = facts["in_one"] / max(facts["in_one"] + 2 * facts["in_two"], 1)
    learned, model = facts["tokens"], Model(facts["words"], min(0.95, max(0.05, share)), strength)
    model.sweeps.append((float(facts["customers"]), float(facts["tables"])))
    model.discount, model.strength = _choose(pair_states, words.filter("kind = 4"), words.filter("kind = 5"), model, word_shards, in_pairs)

    def drawing(sweep: int):
        def draw(key: tuple, state: pa.Table, said: pa.Table) -> pa.Table:
            shard, mine = key[0].as_py(), Pairs(state.column("data")[0].as_py(), word_shards)
            if not len(mine.n):
                return _rows([(6, shard, -1, pack(mine.n))])
            now = dict(_held(said, 6, "block")).get(-1, [np.ones(len(mine.n), dtype=np.int64)])[0]
            _, of_context, c, t = mine.told(_held(said, 4, "block"))
            now = model.draw_pairs(mine.n, now, of_context, c, t, sweep - 1, np.random.default_rng((1, sweep, shard)))
            return _rows([(6, shard, -1, pack(now)), *mine.sums(shard, now)])

        return draw

    kept_words, kept_pairs, drawn = [], [], None
    for sweep in range(1, sweeps + 1):
        said = words.filter("kind = 4").select("kind", "shard", "block", "data")
        if drawn is not None:
            said = said.unionByName(drawn.filter("kind = 6"))
        grouped = _partitions(pair_states, "shard", in_pairs).groupBy("shard").cogroup(_partitions(said, "shard", in_pairs).groupBy("shard"))
        before = drawn, words
        drawn = written(grouped.applyInArrow(drawing(sweep), MESSAGES), "lm-tables")
        words = exchange(words.filter("kind = 5").select("kind", "shard", "block", "data"), drawn.filter("kind = 3"), model, sweep)
        dropped(*(x for x, kept in zip(before, (kept_pairs, kept_words), strict=True) if x is not None and x not in kept))
        facts = totals(words)
        model.sweeps.append((float(facts["customers"]), float(facts["tables"])))
        if sweep > sweeps - 2 and (sweep > 1 or sweeps == 1):
            kept_words.append(words)
            kept_pairs.append(drawn)

    n_kept = len(kept_words)

    def by_sweep(tables: list[DataFrame], kind: int) -> DataFrame:
        """The states of the kept sweeps, ``block`` being the sweep."""
        out = None
        for k, t in enumerate(tables):
            mine = t.filter(F.col("kind") == kind).select("kind", "shard", F.lit(k).cast("bigint").alias("block"), "data")
            out = mine if out is None else out.unionByName(mine)
        return out

    def tell_words(key: tuple, asked: pa.Table, states: pa.Table) -> pa.Table:
        state = [x for _, arrays in _held(states, 5, "block") for x in arrays[3:]]
        out = []
        for block, (rank, n) in _held(asked, 0, "block"):
            known = rank[rank > 0] - 1
            out.append((7, key[0].as_py(), block, pack(rank, n, *(x[known] for x in state))))
        return _rows(out)

    def tell_pairs(key: tuple, asked: pa.Table, states: pa.Table) -> pa.Table:
        state = [arrays[0] for _, arrays in _held(states, 6, "block")]
        return _rows([(8, key[0].as_py(), block, pack(*(x[np.cumsum(at)] for x in state))) for block, (at,) in _held(asked, 1, "block")])

    grouped = _partitions(to_blocks, "shard", in_words).groupBy("shard").cogroup(_partitions(by_sweep(kept_words, 5), "shard", in_words).groupBy("shard"))
    told = grouped.applyInArrow(tell_words, MESSAGES)
    grouped = _partitions(merged.filter("kind = 1"), "shard", in_pairs).groupBy("shard").cogroup(_partitions(by_sweep(kept_pairs, 6), "shard", in_pairs).groupBy("shard"))
    told = told.unionByName(grouped.applyInArrow(tell_pairs, MESSAGES)).unionByName(merged.filter("kind = 0"))

    def settle(row: pa.Table, said: pa.Table) -> pa.Table:
        block, of_words = Block(row), _held(said, 7, "shard")
        number, count = block.numbers(of_words, word_shards), block.places(of_words, word_shards, 1).astype(np.float64)
        u, w, _, pair = block.pairs()
        order, _ = _dealt_pairs(number[u], number[w], count[u].astype(np.int64), pair_shards)
        n = np.zeros(len(u))
        if len(order):
            n[order] = np.concatenate([x[0] for _, x in _held(said, 0, "shard")])
        price = np.zeros(len(u))
        repeated = order[n[order] > 1]
        of_pairs = _held(said, 8, "shard")
        for k in range(n_kept):
            tables, c, t = (np.zeros(len(number)) for _ in range(3))
            by_place = np.argsort((block.hashes.view(np.uint64) % np.uint64(word_shards)).astype(np.int64), kind="stable")
            known = by_place[number[by_place] > 0]
            for i, x in enumerate((tables, c, t)):
                x[known] = np.concatenate([arrays[2 + 3 * k + i] for _, arrays in of_words])
            of_pair = (n > 0).astype(np.float64)
            if len(repeated):
                of_pair[repeated] = np.concatenate([arrays[k] for _, arrays in of_pairs])
            back_off = (model.strength + model.discount * tables[u]) * model.parent(c, t, k - n_kept)[w]
            price += (n - model.discount * of_pair + back_off) / (model.strength + count[u]) / n_kept
        base = np.log10((count + 0.1) / (learned + 0.1 * (model.kinds + 1)))
        doc = np.repeat(np.arange(len(block.size)), block.size)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(block.size))
        return pa.table({
            "doc_id": pa.array(block.ids, mask=~block.known), "held_out": pa.array(block.held), "n_tokens": pa.array(block.size),
            "n_known": pa.array(add(count[block.tokens] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(block.size), learned)),
            "base_score": pa.array(add(base[block.tokens])), "score": pa.array(add(np.log10(price)[pair])),
        })

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(_partitions(told, "block", in_blocks).groupBy("block")).applyInArrow(settle, kind)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of scored rows."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability, learned from those whose crc32 modulo 10 is not 0."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))
    return fit_and_score(documents)
