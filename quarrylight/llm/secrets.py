"""Secret scanning over a trigram inverted index, by DataFrame operations alone.

Each rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived that every match must
satisfy: an OR of ANDs. The index holds postings (trigram, row) for the trigrams that any rule asks for; intersecting
the postings of each alternative gives the rule's candidate rows, and only those are searched with the expression
itself. A rule from which no trigram follows is searched in every row.

Trigrams are of lower-cased text, so a query never misses a match whatever the case.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import shared_dir, unused, written


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: what Java and Python read alike; group and least: matches whose group is shorter are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order of their kinds, then the rules that this method adds: published token formats.
BASE_RULES = [
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=1, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE_RULES + MORE_RULES

#: A set of strings larger than this is not followed further.
_MOST = 64
#: An OR of ANDs: each frozenset is an AND of trigrams; an empty one is always true.
Query = frozenset


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    if len(out) > _MOST:
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return frozenset(x for x in out if not any(y < x for y in out))


_ANY: Query = frozenset([frozenset()])


def _strings(node, flags: int = 0) -> set[str] | None:
    """All strings that one element matches, lower-cased, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        out: set[str] = set()
        for what, v in value:
            if what is sre.LITERAL:
                out.add(chr(v).lower())
            elif what is sre.RANGE and v[1] - v[0] < 16:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is sre.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is sre.BRANCH:
        parts = [_sequence_strings(b) for b in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is sre.MAX_REPEAT and value[1] is not sre.MAXREPEAT and value[1] <= 2:
        inner = _sequence_strings(value[2])
        if inner is None:
            return None
        out, power = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= power
            power = {a + b for a in power for b in inner}
        return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = _strings(node)
        if got is None or len(out) * len(got) > _MOST:
            return None
        out = {a + b for a in out for b in got}
    return out


def _query(nodes) -> Query:
    """The trigram query of a sequence: runs of elements with few strings give their trigrams, others what their inside needs."""
    result, run = _ANY, {""}

    def flush() -> None:
        nonlocal result, run
        result = _both(result, frozenset(_grams(s) for s in run))
        run = {""}

    for node in nodes:
        got = _strings(node)
        if got is not None and len(run) * len(got) <= _MOST:
            run = {a + b for a in run for b in got}
            continue
        flush()
        kind, value = node
        if got is not None:
            run = got
        elif kind is sre.SUBPATTERN:
            result = _both(result, _query(value[-1]))
        elif kind is sre.BRANCH:
            result = _both(result, frozenset().union(*(_query(b) for b in value[1])))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            result = _both(result, _query(value[2]))
    flush()
    return result


def trigram_query(pattern: str) -> list[list[str]] | None:
    """An OR of ANDs of trigrams that every match of pattern satisfies; None if none is mandatory."""
    found = _query(list(sre_parse.parse(pattern)))
    if any(not x for x in found):
        return None
    return sorted(sorted(x) for x in found)


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches of a rule that are long enough: array<struct<start, kind, end>>, in code points."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # the text around the matches gives their places: a piece before each match, and one after the last
    around = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("a"), hits.alias("h"), groups.alias("g")), lambda x: F.struct(
        F.length(x["a"]).alias("gap"), F.length(x["h"]).alias("size"), F.length(x["g"]).alias("kept")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["kept"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(around, zero, step, lambda acc: acc["out"])


def build_index(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram int): a posting for each of the given trigrams that a row's lower-cased text holds."""
    low = documents.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[list[int]]]) -> DataFrame:
    """(doc_id, rules array<int>): the rows that satisfy the query of each rule, by intersecting postings.

    The queries are those of the rules, so of fixed size, and are broadcast."""
    spark = index.sparkSession
    needs = [(t, rule, alternative, len(grams)) for rule, query in queries.items() for alternative, grams in enumerate(query) for t in grams]
    wanted = spark.createDataFrame(needs, "trigram int, rule int, alternative int, needed int")
    postings = index.join(F.broadcast(wanted), "trigram")
    met = postings.groupBy("doc_id", "rule", "alternative", "needed").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == F.col("needed"))
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def scan(documents: DataFrame, rules: list[Rule] = RULES, broadcast_rows: int = 400_000) -> DataFrame:
    """documents plus secret_spans: array<struct<start int, kind int, end int>>, by start and then kind (a rule's number).

    documents: doc_id, text and any other columns, which are kept; an existing secret_spans is replaced. Null and empty
    texts have no spans; a null doc_id is a value like others, and rows that share a doc_id are each searched for the
    candidate rules of any of them, so the result is the same as for the row alone.

    The index holds the trigrams of the given rules and is made anew with every call: rules and texts both change.
    Candidates join their texts by broadcast if there are at most ``broadcast_rows`` of them, else by a shuffled join.
    """
    documents = documents.drop("secret_spans")
    key, asked = unused(documents, "_id"), unused(documents, "_rules")
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    trigrams = sorted({t for q in queries.values() if q for grams in q for t in grams})
    number = {t: i for i, t in enumerate(trigrams)}
    indexed = {i: [[number[t] for t in grams] for grams in q] for i, q in queries.items() if q}
    if indexed:
        shared_dir(documents.sparkSession)
        found = written(candidates(build_index(documents, trigrams), indexed), "secret-candidates").select(F.col("doc_id").alias(key), F.col("rules").alias(asked))
        if found.count() <= broadcast_rows:
            found = F.broadcast(found)
        rows = documents.join(found, documents["doc_id"].eqNullSafe(found[key]), "left").drop(key)
    else:
        rows = documents.withColumn(asked, F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        worth = F.array_contains(asked, i) if i in indexed else F.col("text").rlike(_long_run(rule))
        parts.append(F.when(worth, rule_spans(F.coalesce("text", F.lit("")), rule, i)).otherwise(none))
    return rows.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop(asked)


def _long_run(rule: Rule) -> str:
    """A cheaper expression that a row with a long enough match satisfies: for [class]+ a run of that length."""
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") and rule.pattern.count("]") == 1:
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def redact(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """documents with every secret in text replaced by [SECRET]; overlapping spans are replaced as one."""
    found = scan(documents, rules)  # its secret_spans replaces a column of that name, which redact drops
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, span["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate("secret_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    return found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("text"))).drop("secret_spans")


def _listing(spans: Column, kinds: list[str]) -> Column:
    name = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    kinds = [r.kind for r in RULES]
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda i: F.size(F.filter("secret_spans", lambda s: s["kind"] == i)).cast("bigint")
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(_listing(base, kinds), 256).alias("base_sha256"),
        _listing(F.col("secret_spans"), kinds).alias("spans"),
    )


def _sql() -> str:
    """The same by DuckDB's regular expressions, rule by rule over every row, without an index."""
    quoted = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        parts.append(
            f"SELECT doc_id, text, {i} AS kind, '{r.kind}' AS name, {r.least} AS least, string_split_regex(text, '{quoted(r.pattern)}') AS gaps, "
            f"regexp_extract_all(text, '{quoted(r.pattern)}', 0) AS hits, regexp_extract_all(text, '{quoted(r.pattern)}', {r.group}) AS kept FROM t"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
numbered AS (SELECT doc_id, kind, name, least, gaps, hits, kept, unnest(generate_series(1, len(hits))) AS i FROM found WHERE len(hits) > 0),
sized AS (
  SELECT doc_id, kind, name, least, i, length(gaps[i]) AS gap, length(hits[i]) AS size, length(kept[i]) AS kept FROM numbered
), placed AS (
  SELECT doc_id, kind, name, least, kept, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) - size AS start, size FROM sized
), spans AS (
  SELECT doc_id, kind, start, name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM placed WHERE kept >= least
), listed AS (
  SELECT doc_id,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE_RULES)}), '') AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed USING (doc_id)
"""


OP4_SQL = _sql()
