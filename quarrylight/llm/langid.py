"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is parsed
from left to right into the fewest phrases that occur there: each phrase is the longest match from where the last one
ended. A character that the text lacks counts as two, one to say so and one to name it. c phrases cost about c * log2(N)
bits, where N is the length of the longest language's text, the same for all, so that a language of which little is known
gains nothing by its small sample; divided by the document's length this estimates the cross entropy, and the language
with the least wins, ties going to the smaller name.

Texts are compared as runs of lower-cased letters with one space between them. The automata are built from a bounded
sample (``chars_per_language``, ``chars_per_row``) of labelled rows; every document is parsed as a whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .common import crc_mod, tidy, with_struct

_NOT_LETTER = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, one space between; "" if there is no letter."""
    return _NOT_LETTER.sub(" ", (text or "").lower()).strip()


def suffix_automaton(text: str) -> dict:
    """The initial state; a state maps a character to the next state, and the paths spell exactly the substrings of text."""
    root: dict = {}
    states, length, link = [root], [0], [-1]
    last = 0
    for ch in text:
        new = len(states)
        states.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in states[p]:
            states[p][ch] = new
            p = link[p]
        if p >= 0:
            q = states[p][ch]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(states)
                states.append(dict(states[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and states[p].get(ch) == q:
                    states[p][ch] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    for state in states:
        for ch, to in state.items():
            state[ch] = states[to]
    return root


def phrases(root: dict, text: str, limit: float = math.inf) -> int:
    """How many phrases the greedy parse of text needs, an unknown character counting as two; once they exceed limit, the
    number so far."""
    count, state = 0, root
    for ch in text:
        to = state.get(ch)
        if to is None:
            if state is not root:
                count += 1
            to = root.get(ch)
            if to is None:
                count += 2
                to = root
            if count > limit:
                return count
        state = to
    return count + (state is not root)


class CrossParser:
    """samples: text by language, in the form that letters() gives."""

    #: How sharply score falls with the bits a character by which a rival is worse.
    SHARPNESS = 8.0
    #: A rival this many bits a character worse than the best is certain to lose and is not parsed further.
    MARGIN = 1.0

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(lang for lang, text in samples.items() if text)
        self.roots = [suffix_automaton(samples[lang]) for lang in self.languages]
        self.bits = math.log2(max(map(len, samples.values()), default=0) + 1)

    def rates(self, plain: str) -> list[float]:
        """Estimated cross entropy against each language, in bits a character; losers' only up to MARGIN above the least."""
        n, start = len(plain), plain[:200]
        order = sorted(range(len(self.roots)), key=lambda i: phrases(self.roots[i], start))
        least, found = math.inf, [0.0] * len(order)
        for i in order:
            found[i] = phrases(self.roots[i], plain, (least + self.MARGIN) * n / self.bits) * self.bits / n
            least = min(least, found[i])
        return [min(r, least + self.MARGIN) for r in found]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, bits a character); ("und", 0, 0) without a letter or a learned language."""
        plain = letters(text)
        if not plain or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        rates = self.rates(plain)
        best = min(range(len(rates)), key=rates.__getitem__)
        return self.languages[best], 1 / sum(math.exp(self.SHARPNESS * (rates[best] - r)) for r in rates), rates[best]


def learn(labelled: DataFrame, chars_per_language: int = 40_000, chars_per_row: int = 1_500, most_languages: int = 256) -> dict[str, str]:
    """Sample text by language from (doc_id, text, lang) rows with a language.

    Rows are taken at random by a hash of doc_id, about twice as many as are needed at the mean length, and of each a
    passage of at most ``chars_per_row`` letters at a place that the hash chooses, until a language has
    ``chars_per_language``. Rows with a null text or language, and texts without letters, teach nothing; a language without
    text is not learned. Of more than ``most_languages`` values of lang, those of the most rows are learned, the others
    being taken for dirt; ties go to the smaller name.
    """
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(chars_per_row))).alias("chars"))
    sizes = {r["lang"]: r["chars"] or 0 for r in sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * chars_per_language / max(chars, 1))) for lang, chars in sizes.items()], "lang string, share double")
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    gathered: dict[str, list[str]] = {lang: [] for lang in sizes}
    room = dict.fromkeys(sizes, chars_per_language)
    least = 4 * chars_per_row  # characters: letters are fewer
    place = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - least, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.join(F.broadcast(shares), "lang").filter(rank < F.col("share") * (1 << 40))  # most_languages rows at most
    chosen = chosen.select("lang", rank.alias("rank"), "doc_id", F.substring("text", place, F.lit(least)).alias("text"))
    for r in sorted(chosen.collect(), key=lambda r: (r["rank"], r["doc_id"], r["text"])):
        piece = letters(r["text"])[: max(0, min(chars_per_row, room[r["lang"]]))]
        if piece:
            gathered[r["lang"]].append(piece)
            room[r["lang"]] -= len(piece) + 1
    return {lang: " ".join(pieces) for lang, pieces in gathered.items()}


def identify(documents: DataFrame, samples: dict[str, str]) -> DataFrame:
    """documents plus lang_pred, score (0 to 1) and bits_per_char; columns of these names are replaced, others kept.

    Rows are judged one by one, so repeated rows and an empty table need no rule: null and empty texts and texts without
    letters are "und" with score 0, as is every text if no language was learned; of equally good languages the smaller name
    wins. Long texts are parsed whole against the winner; a rival is parsed until it is ``CrossParser.MARGIN`` bits a
    character behind, and counts as that far behind in the score, which it then lowers by less than 0.0004.
    """
    shared = documents.sparkSession.sparkContext.broadcast(samples)  # chars_per_language a language at most

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = CrossParser(shared.value)
        for texts in batches:  # one text at a time is turned into a string
            rows = zip(*(parser.predict(text.as_py()) for text in texts), strict=True) if len(texts) else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.float64(), pa.float64()), strict=True)], ["lang_pred", "score", "bits_per_char"])

    judged = tidy(run)  # the automata are large
    judged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(judged, "struct<lang_pred:string,score:double,bits_per_char:double>")
    judge = judge.asNondeterministic()  # else a filter on the result judges every text twice, with automata in two workers a task
    return with_struct(documents, judge(F.col("text")), ["lang_pred", "score", "bits_per_char"])


def training_rows(documents: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1, and the language is known."""
    return documents.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", 3) != 1))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = table(spark, sf_dir, "documents")
    judged = identify(documents.select("doc_id", "text"), learn(training_rows(documents)))
    return judged.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_char")
