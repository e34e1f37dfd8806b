"""Exact n-gram Jaccard join with token-combination prefixes.

Documents are sets of hashed word shingles. Documents with equal sets are one node from the start. Two sets with
Jaccard similarity of at least t that are read in one global order (by hash) differ in at most (1 - t) * n places each, so

* among their first (1 - t) * n + K tokens they share at least K (prefixes extended by K);
* of the first (1 - t) * 3 * n + 1 runs of three tokens that are neighbours in the order, they share at least one.

Single tokens of the extended prefix are indexed first. Tokens in at most ``rare`` prefixes are the rare class and
lead to pairs directly; a pair that shares fewer than K tokens, frequent ones counted in its favour, is discarded. A
document with fewer than K frequent tokens in its prefix has only such partners. The others are indexed again by
combinations of three tokens. What remains, pairs and combinations, gives clusters of possible partners; within a cluster
pairs are verified on the whole sets, in tiles of bounded rows and tokens, so no group meets in one task. Only a spanning
forest of the verified links leaves a tile. A cluster of many tiles is cut into blocks: first each block by itself, then a
few representatives of what hangs together within each block, then only those pairs of blocks that are not yet one
component. Copies of one text thus cost about one comparison with their block each, not one with every other block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table
from .common import chunks, dropped, small_side, spread_join, tidy, written
from .components import components

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose words are held at a time; their arrays take about ten times the room.
CHUNK_BYTES = 1 << 20
#: Tokens in a combination of the frequent class.
COMBINED = 3


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64): of ``words`` consecutive words, A-Z lower-cased and parted
    by ASCII white space; of all words if there are fewer; none without words or for a null text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends = ends - ends[0]
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    index = coded.indices.to_numpy()
    real = np.array([w != "" for w in names], dtype=bool)[index] if len(index) else np.zeros(0, bool)
    word = hashes[index] if len(index) else np.zeros(0, np.uint64)
    before = np.concatenate([[0], np.cumsum(real)])
    ends, word = before[ends], word[real]
    rolled = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * _MULTIPLIER + word[k : k + len(rolled)]
    rolled = _mixed(rolled + np.uint64(words))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _MULTIPLIER + w
                yield _mixed(np.array([h + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Rule:
    """The bounds that a similarity of at least num / den puts on sets of n tokens."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.apart = 1 - Fraction(num, den)

    def missing(self, n: int) -> int:
        """How many of its tokens a partner may lack."""
        return int(self.apart * n)

    def extension(self, n: int) -> int:
        """K: shared tokens that the extended prefix guarantees."""
        return n // 20 + 1

    def prefix(self, n: int) -> int:
        return min(n, self.missing(n) + self.extension(n))

    def least_extension(self, n: int) -> int:
        """The least K of any partner of a set of n."""
        return self.extension(-(-self.num * n // self.den))

    def combinations(self, n: int) -> int:
        return int(self.apart * COMBINED * n) + 1

    def linked(self, both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (both * self.den >= self.num * (n + m - both)) & (both > 0)


def _signature(s: np.ndarray) -> int:
    """A node's number: 64 bits of a digest of the whole set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(documents: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(doc_id, text_hash, node, n, prefix binary) of every row; node is null for a row without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            nodes, sizes, prefixes = [], [], []
            for s in shingle_sets(batch.column("text"), words):
                nodes.append(_signature(s) if len(s) else None)
                sizes.append(len(s))
                prefixes.append(s[: rule.prefix(len(s))].tobytes())
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "prefix"])

    return _keyed(documents).mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, node bigint, n int, prefix binary")


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): the last two name a row's text even where ids repeat or are null."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _tokens(nodes: DataFrame) -> DataFrame:
    """(token, node, n): a row for every token of every prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2 << 20):
            data = [np.frombuffer(p.as_buffer(), dtype="<i8") for p in batch.column("prefix")]
            count = [len(d) for d in data]
            repeat = lambda c: np.repeat(batch.column(c).to_numpy(), count)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(data)), pa.array(repeat("node")), pa.array(repeat("n"))], ["token", "node", "n"])

    return nodes.select("node", "n", "prefix").mapInArrow(tidy(run), "token bigint, node bigint, n int")


def _texts_of(documents: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """The texts of the rows that ``wanted`` (doc_id, text_hash, ..) names, with its other columns; broadcast if it is small."""
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    wanted = small_side(wanted, broadcast_rows)
    return _keyed(documents).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).drop("_d", "_t")


def _combined_keys(texts: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(key, node): the three-token combinations of (node, text) rows; small sets add their single tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            keys, nodes = [], []
            for node, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), words), strict=True):
                if len(s) and _signature(s) == node:
                    r = np.zeros(max(len(s) - COMBINED + 1, 0), dtype=np.uint64)
                    for k in range(COMBINED):
                        r = r * _MULTIPLIER + s[k : k + len(r)]
                    key = _mixed(r)[: rule.combinations(len(s))]
                    if len(s) <= 8:
                        key = np.concatenate([key, s])
                    keys.append(key)
                    nodes.append(np.full(len(key), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return texts.select("node", "text").mapInArrow(tidy(run), "key bigint, node bigint")


def _forest(nodes: list[int], sets: list[np.ndarray], left: int, rule: Rule) -> list[tuple[int, int]]:
    """Of the links that the first ``left`` sets have, among themselves and to the others, what hangs together: an edge from each
    node to the least of its component."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(left):
        a = np.searchsorted(tokens, sets[i], "left")
        count = np.searchsorted(tokens, sets[i], "right") - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        both = np.bincount(owners[at], minlength=len(sets))
        for j in np.flatnonzero(rule.linked(both, sizes[i], sizes)).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, node in enumerate(nodes):
        least[find(i)] = min(node, least.get(find(i), node))
    return [(node, least[find(i)]) for i, node in enumerate(nodes) if node != least[find(i)]]


_TILE = pa.schema([("cluster", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("mine", pa.int32()), ("node", pa.int64()), ("hashes", pa.binary())])


def _tiled(texts: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(u, v): what (node, cluster, mine, others array<int>, text) rows are linked, as edges to the least node of what hangs
    together in a tile.

    Rows of a cluster meet in a tile for each two blocks ``mine`` and one of ``others``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            rows: list[tuple] = []
            columns = (batch.column(k).to_pylist() for k in ("cluster", "mine", "others", "node"))
            held = 0
            for cluster, mine, others, node, s in zip(*columns, shingle_sets(batch.column("text"), words), strict=True):
                if len(s) and _signature(s) == node:
                    raw = s.tobytes()
                    for other in others:
                        rows.append((cluster, min(mine, other), max(mine, other), mine, node, raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _tile_rows(rows)
                            rows, held = [], 0
            if rows:
                yield _tile_rows(rows)

    def links(tile: tuple | None, held: dict[int, tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        names = sorted(held, key=lambda k: (held[k][0] != tile[1], k))
        return _forest(names, [held[k][1] for k in names], sum(held[k][0] == tile[1] for k in names), rule)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            out = []
            for *this, mine, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(this) != tile:
                    out += links(tile, held)
                    tile, held = tuple(this), {}
                held[node] = mine, np.frombuffer(raw, dtype="<u8")
            yield _edges(out)
        yield _edges(links(tile, held))

    dealt = texts.select("node", "cluster", "mine", "others", "text").mapInArrow(tidy(sets), "cluster bigint, i int, j int, mine int, node bigint, hashes binary")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return dealt.mapInArrow(tidy(tiles), "u bigint, v bigint")


def _tile_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TILE.types, strict=True)], schema=_TILE)


def _blocked(members: DataFrame, tile_rows: int, tile_tokens: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """(members plus mine: their block, big: (cluster, blocks) of the clusters of several blocks).

    members: (cluster, node, n, ..), at least; a block has about tile_rows nodes and tile_tokens tokens at most."""
    blocks = F.ceil(F.greatest(F.count("*") / tile_rows, F.sum("n") / tile_tokens)).cast("int")
    big = written(members.groupBy("cluster").agg(blocks.alias("blocks")).filter(F.col("blocks") > 1), "jaccard-big")
    rows = spread_join(members, big, "cluster", "left", spread)
    return rows.withColumn("mine", F.pmod(F.col("node"), F.coalesce("blocks", F.lit(1))).cast("int")), big


def _verified(documents: DataFrame, members: DataFrame, words: int, rule: Rule, tile_rows: int, tile_tokens: int, broadcast_rows: int) -> DataFrame:
    """(u, v): verified links within the clusters of members (cluster, node, n, doc_id, text_hash), enough to connect them."""
    columns = ["doc_id", "text_hash", "node", "cluster", "mine", "others"]
    meet = lambda rows: written(_tiled(_texts_of(documents, written(rows.select(columns), "jaccard-wanted"), broadcast_rows), words, rule), "jaccard-links")
    rows, big = _blocked(members, tile_rows, tile_tokens, broadcast_rows)
    rows = written(rows, "jaccard-blocked")
    links = meet(rows.withColumn("others", F.array("mine")))
    if big.isEmpty():
        return links

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        """rows plus label: the least node of what hangs together in a node's own tile, or the node itself."""
        found = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
        return rows.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))

    many = written(labelled(rows.filter(F.col("blocks").isNotNull()), links), "jaccard-many")
    near = Window.partitionBy("cluster", "mine", "label").orderBy(F.xxhash64("node"), "node")
    few = many.withColumn("at", F.row_number().over(near)).filter(F.col("at") <= 8).select("cluster", "node", "n", "doc_id", "text_hash", F.col("label").alias("first"))
    few, _ = _blocked(written(few, "jaccard-few"), tile_rows, tile_tokens, broadcast_rows)
    few = written(few, "jaccard-few-blocked")
    more = meet(few.withColumn("others", F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    links = links.unionByName(more)
    # The representatives of one label may have met others in several tiles; it counts as one with others only where all agree.
    again = labelled(few, more.groupBy("u").agg(F.min("v").alias("v"))).groupBy("cluster", "first").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    again = written(again.filter("a = b").select("cluster", F.col("first").alias("label"), F.col("a").alias("merged")), "jaccard-merged")
    many = many.join(small_side(again, broadcast_rows), ["cluster", "label"], "left").withColumn("label", F.coalesce("merged", "label"))

    # A pair of blocks that is one component by now has nothing to add.
    state = many.groupBy("cluster", "mine").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    state = written(state, "jaccard-state")
    other = state.select("cluster", F.col("mine").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    open_ = state.join(other, "cluster").filter((F.col("mine") != F.col("other")) & ((F.col("a") != F.col("ob")) | (F.col("b") != F.col("oa"))))
    open_ = written(open_.groupBy("cluster", "mine").agg(F.collect_list("other").alias("others")), "jaccard-open")
    if open_.isEmpty():
        return links
    return links.unionByName(meet(many.join(small_side(open_, broadcast_rows), ["cluster", "mine"])))


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])


def _grouped(documents: DataFrame, words: int, num: int, den: int, rare: int, tile_rows: int, tile_tokens: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): every row's (doc_id, text_hash, node, n), and every node's (node, doc_id, text_hash) of the first row of
    its group: that of the least id, null ids last."""
    rule = Rule(num, den)
    rows = written(sketch(documents, words, rule), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(first.alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = written(nodes.select("node", "first", "first.doc_id", "first.text_hash", "n", "prefix"), "jaccard-nodes")

    # Single tokens. Those of one prefix lead nowhere.
    tokens = _tokens(nodes)
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    index = written(tokens.join(shared, "token"), "jaccard-index")
    lists = index.filter(F.col("df") <= rare).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("held"))
    lists = lists.groupBy("held").agg(F.count("*").alias("times"))  # copies share most of their tokens: one list for all of those
    left = lists.select(F.posexplode("held").alias("at", "a"), "held", "times")
    pairs = left.select("a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"), "times")
    fits = F.col("b.n") * den >= F.col("a.n") * num
    fits = fits & (F.col("a.n") * den >= F.col("b.n") * num)
    pairs = pairs.filter(fits).groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.least("a.n", "b.n").alias("n")).agg(F.sum("times").alias("times"))
    frequent = written(index.filter(F.col("df") > rare).groupBy("node", "n").agg(F.count("*").alias("f")), "jaccard-frequent")
    part = lambda k: frequent.select(F.col("node").alias(k), F.col("f").alias(f"f{k}"))
    pairs = pairs.join(part("u"), "u", "left").join(part("v"), "v", "left")
    extension = F.floor(F.col("n") / 20) + 1
    pairs = pairs.filter(F.col("times") + F.least(F.coalesce("fu", F.lit(0)), F.coalesce("fv", F.lit(0))) >= extension).select("u", "v")

    # Combinations of three tokens, for documents whose prefixes hold many frequent tokens.
    least = F.floor(F.ceil(F.col("n") * num / den) / 20) + 1
    dense = frequent.filter(F.col("f") >= least).select("node").join(nodes.select("node", "doc_id", "text_hash"), "node")
    dense = written(dense, "jaccard-dense")
    keys = written(_combined_keys(_texts_of(documents, dense, broadcast_rows), words, rule).distinct(), "jaccard-keys")
    hubs = keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("df")).filter(F.col("df") > 1)
    stars = keys.join(hubs, "key").select(F.col("node").alias("u"), "v").filter(F.col("u") != F.col("v")).distinct()

    clusters = components(pairs.unionByName(stars)).withColumnRenamed("label", "cluster")
    members = written(clusters.join(nodes.select("node", "n", "doc_id", "text_hash"), "node"), "jaccard-members")
    links = _verified(documents, members, words, rule, tile_rows, tile_tokens, broadcast_rows)

    found = written(components(links).join(nodes.select("node", "first"), "node"), "jaccard-found")
    firsts = written(found.groupBy("label").agg(F.min("first").alias("group")), "jaccard-firsts")
    joined = spread_join(found.select("node", "label"), firsts, "label", "inner", broadcast_rows).select("node", "group")
    group = F.coalesce("group", "first")
    groups = nodes.select("node", "first").join(joined, "node", "left").select("node", group["doc_id"].alias("doc_id"), group["text_hash"].alias("text_hash"))
    dropped(index, frequent, dense, keys)
    return rows.select("doc_id", "text_hash", "node", "n"), groups


def jaccard_components(documents: DataFrame, words: int = 4, num: int = 85, den: int = 100, rare: int = 24, tile_rows: int = 1024, tile_tokens: int = 1 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles bigint, component_id) for every row of documents (doc_id, text; other columns are ignored).

    Two rows link when den * |intersection| >= num * |union| of their shingle sets; component_id is the least doc_id that
    links reach, a row without words being alone. Rows with equal sets are one node, whatever their number. A null doc_id
    names no component: such rows take part, but get the least non-null id they reach, null if there is none. Rows that
    share a doc_id are rows of their own. Whole texts are compared, however long; an empty table gives an empty result.
    Tables of up to ``broadcast_rows`` narrow rows are broadcast; larger ones are joined by key.
    """
    rows, groups = _grouped(documents, words, num, den, rare, tile_rows, tile_tokens, broadcast_rows)
    out = rows.join(groups.select("node", F.col("doc_id").alias("component_id")), "node", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, words: int = 5, num: int = 4, den: int = 5, rare: int = 24, tile_rows: int = 1024, tile_tokens: int = 1 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of documents, all columns, one of each group of near duplicates: that of the least id, null ids last.

    Rows are told apart by id and text, so ids that repeat do no harm; of rows with the same id and text one stays, as
    they are copies of each other. Rows without words all stay. An empty table stays empty."""
    rows, groups = _grouped(documents, words, num, den, rare, tile_rows, tile_tokens, broadcast_rows)
    key = ["doc_id", "text_hash"]
    found = rows.join(groups.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "node")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("d")) | (F.col("text_hash") != F.col("t"))).select(*key).distinct()
    gone = written(gone.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}), "jaccard-gone")
    here = documents["doc_id"].cast("bigint"), F.xxhash64(documents["text"].cast("string"))
    at = lambda df: here[0].eqNullSafe(df["_d"]) & (here[1] == df["_t"])
    gone = small_side(gone, broadcast_rows)
    kept = documents.join(gone, at(gone), "left_anti")
    again = rows.filter(F.col("node").isNotNull()).groupBy(*key).agg(F.count("*").alias("times")).filter(F.col("times") > 1)
    again = written(again.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")), "jaccard-again")
    if again.isEmpty():
        return kept
    again = small_side(again, broadcast_rows)
    twice = kept.join(again, at(again), "left_semi")
    once = kept.join(again, at(again), "left_anti")
    return once.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 4-word shingles, Jaccard at least 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
