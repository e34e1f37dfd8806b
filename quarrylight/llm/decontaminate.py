"""Benchmark decontamination by a prefix-filtered join of word shingles, by DataFrame operations alone.

A benchmark item is cut into windows of ``window`` consecutive words (an item with fewer words is one window). A window
is a set of short shingles; a document that contains it contains all of them, so for exact containment the necessary
prefix is one shingle, best the rarest: shingles are ordered by how often they occur in all documents. Documents meet a
window only where its rarest shingle stands; the window must then fit between the document's ends (length and positional
bounds), and its words are compared one by one with those in that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import small_side, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character: words are digits, letters a-z and all beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """The words of a text, A-Z lower-cased; none for a null or empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), NOT_WORD, -1), lambda w: w != "")


def _shingles(array: str, g: int) -> Column:
    """array<struct<pos, h>>: the hash of every g consecutive words and the place of the first, from 0."""
    parts = [F.col(array) if i == 0 else F.slice(F.col(array), F.lit(i + 1), F.greatest(F.size(array), F.lit(1))) for i in range(g)]
    zipped = F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)])
    hashed = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(*[x[f"w{k}"] for k in range(g)]).alias("h")))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(array) - (g - 1), F.lit(0)))


def benchmark_windows(items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): windows (window_id string, words array<string>), distinct; owners (window_id, item_id)."""
    cut = items.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    n, size = F.size("w"), F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.greatest(n - window, F.lit(0)) + 1)
    cut = cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("words"))
    # 128 bits of a digest name a window: its words have no space in them
    named = cut.select("item_id", F.md5(F.concat_ws(" ", "words").cast("binary")).alias("window_id"), "words").dropDuplicates(["item_id", "window_id"])
    return named.select("window_id", "words").dropDuplicates(["window_id"]), named.select("window_id", "item_id")


def window_shingles(windows: DataFrame, shingle: int = 3) -> DataFrame:
    """(window_id, g, h, pos): all shingles of every window; g is the number of words, ``shingle`` or the window's own."""
    out = None
    for g in range(1, shingle + 1):
        rows = windows.filter(F.size("words") >= g if g == shingle else F.size("words") == g)
        rows = rows.select("window_id", F.lit(g).alias("g"), F.explode(_shingles("words", g)).alias("s")).select("window_id", "g", "s.h", "s.pos")
        out = rows if out is None else out.unionByName(rows)
    return out


def _around(array: str, pos: Column, window: int) -> Column:
    """The words from window - 1 before pos to window - 1 after it."""
    first = F.greatest(pos - (window - 1), F.lit(0))
    return F.slice(F.col(array), first + 1, pos + window - first)


def _is_one_of(values: list[int]):
    return lambda s: s["h"].isin(values)


def _matched_in_row(docs: DataFrame, held: list[tuple[int, int]]) -> DataFrame:
    """docs (.., w) plus places array<struct<pos, h>>: where a shingle of ``held`` (g, h) stands, tested in the row."""
    parts = []
    for g in sorted({g for g, _ in held}):
        values = [h for k, h in held if k == g]
        parts.append(F.filter(_shingles("w", g), _is_one_of(values)))
    places = F.concat(*parts) if len(parts) > 1 else parts[0]
    return docs.withColumn("places", places)


def _matched_by_join(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The same by a shuffled join on the shingle, for benchmarks with too many shingles for a list."""
    parts = None
    for g in [r["g"] for r in shingles.select("g").distinct().collect()]:
        rows = docs.select("doc_id", "text_hash", F.explode(_shingles("w", g)).alias("s")).select("doc_id", "text_hash", "s.*")
        rows = rows.join(shingles.filter(F.col("g") == g).select("h").distinct(), "h", "left_semi")
        parts = rows if parts is None else parts.unionByName(rows)
    found = parts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "h")).alias("places"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "places")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left").drop("_d", "_t")
    return joined.withColumn("places", F.coalesce("places", F.array().cast("array<struct<pos:int,h:bigint>>")))


def contamination(documents: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, list_limit: int = 50_000) -> DataFrame:
    """One row for every row of documents: (doc_id, text_hash, n_words, n_hit, items array<string>).

    documents (doc_id, text), items (item_id, text); other columns are ignored. n_hit: words of the document inside an
    occurrence of any window; items: the sorted ids of items of which a window occurs. Null and empty texts have no words
    and hold no window; a null doc_id is kept; rows with the same doc_id and text get the same answer. An item without
    words is contained nowhere; items with the same windows are all reported. An empty benchmark or table is no error.

    A benchmark with up to ``list_limit`` distinct shingles is tested for inside each row, without a shuffle of the
    texts; a larger one by a shuffled join.
    """
    windows, owners = benchmark_windows(items, window)
    windows, owners = written(windows, "decon-windows"), written(owners, "decon-owners")
    shingles = written(window_shingles(windows, shingle), "decon-shingles")
    distinct = shingles.select("g", "h").distinct()
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    n = distinct.count()
    if not n:
        matched = docs.withColumn("places", F.array().cast("array<struct<pos:int,h:bigint>>"))
    elif n <= list_limit:
        matched = _matched_in_row(docs, [(r["g"], r["h"]) for r in distinct.collect()])
    else:
        matched = _matched_by_join(docs, shingles)
    matched = matched.select(
        "doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"),
        F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"), F.greatest(p["pos"] - (window - 1), F.lit(0)).alias("first"), _around("w", p["pos"], window).alias("ctx"))).alias("hits"),
    )
    matched = written(matched, "decon-matched")
    hits = matched.select("doc_id", "text_hash", F.explode("hits").alias("x")).select("doc_id", "text_hash", "x.*")
    # Rarity over all documents; a shingle that occurs in none rules its windows out altogether.
    rarity = hits.groupBy("h").agg(F.count("*").alias("n"))
    ranked = shingles.join(rarity, "h", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "pos")).alias("p"))
    prefix = ranked.filter(F.col("p.n") > 0).select("window_id", F.col("p.h").alias("h"), F.col("p.pos").alias("offset")).join(windows, "window_id")
    joined = hits.join(prefix, "h").withColumn("start", F.col("pos") - F.col("offset"))
    inside = (F.col("start") >= F.col("first")) & (F.slice("ctx", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.size("words")) == F.col("words"))
    verified = written(joined.filter(inside).select("doc_id", "text_hash", "window_id", "start", F.size("words").alias("n")).distinct(), "decon-verified")
    key = ["doc_id", "text_hash"]
    covered = verified.select(*key, "start", "n").distinct().select(*key, F.explode(F.expr("sequence(start, start + n - 1)")).alias("word")).distinct()
    counts = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    named = verified.select(*key, "window_id").distinct().join(owners, "window_id").select(*key, F.col("item_id").cast("string").alias("item_id")).distinct()
    named = named.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    base = matched.select(*key, "n_words")
    both = counts.alias("c").join(named.alias("n"), same_key("c", "n")).select("c.doc_id", "c.text_hash", "n_hit", "items")
    out = base.alias("b").join(both.alias("f"), same_key("b", "f"), "left").select("b.doc_id", "b.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out


def same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_hash").eqNullSafe(F.col(f"{b}.text_hash"))


def keep_clean(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents, all columns, in which no window of the benchmark occurs; null and empty texts stay, and rows that
    share a doc_id are judged by their own text."""
    bad = contamination(documents, items, window).filter(F.col("n_hit") > 0).select("doc_id", "text_hash").distinct()
    bad = small_side(written(bad, "decon-bad"))
    key, text = unused(documents, "_id"), unused(documents, "_hash")
    bad = bad.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text))
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(documents["text"]) == bad[text]), "left_anti")


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_SQL_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda w: w <> '')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(words) AS n FROM cut),
places AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)
), met AS (SELECT doc_id, p, n, item_id FROM places JOIN cut USING (words)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
