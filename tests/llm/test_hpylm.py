import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarrylight.llm.common import crc_mod
from quarrylight.llm.hpylm import CHOICES, EXACT, Model, draw_tables, fit_and_score, left_out, left_out_repeated, perplexity, stirling
from quarrylight.llm.packing import pack, pair_steps, pairs_of, unpack

SCHEMA = "doc_id bigint, text string, score string, n int"


def tokens(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def corpus():
    r = np.random.default_rng(3)
    vocabulary = ["The", "the", "of", "é́x", "naïve", "A", *(f"w{i}ing" for i in range(60))]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(r.choice(vocabulary, size=r.integers(0, 60), p=weight / weight.sum())) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \t\n", "unseen words here", "the " * 5000])]
    return rows + [(5, texts[5]), (None, "the of")]


def test_base_counts_and_gain(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).withColumn("held_out", crc_mod("doc_id", 10) == 0).repartition(3)
    out = fit_and_score(df)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    train = Counter(w for d, t in rows if not held(d) for w in [*tokens(t), None])
    total, kinds = sum(train.values()), len(train)
    want = sorted(
        (-1 if d is None else d, held(d), len(tokens(t)) + 1, sum(train[w] > 0 for w in [*tokens(t), None]), total,
         round(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*tokens(t), None]), 6))
        for d, t in rows
    )
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out.collect())
    assert out.orderBy("doc_id", "score").collect() == fit_and_score(df).orderBy("doc_id", "score").collect()
    gain = {r.held_out: r.base_perplexity / r.perplexity for r in perplexity(out).collect()}
    assert gain[False] > 1 and gain[True] > 0.97  # the words are drawn independently: contexts tell nothing of held-out ones


def test_empty_table_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    assert fit_and_score(df.limit(0).withColumn("held_out", F.lit(False))).collect() == []
    r = fit_and_score(df.withColumn("held_out", F.lit(True))).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)


def test_packing():
    r = np.random.default_rng(0)
    u, w = r.integers(1, 50, 1000), r.integers(1, 10**6, 1000)
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    back = pairs_of(*unpack(pack(*pair_steps(u, w))))
    assert (back[0] == u).all() and (back[1] == w).all()
    odd = np.array([-5, 3, 1 << 62, -(1 << 63)])
    assert (unpack(pack(odd, np.zeros(0)))[0] == odd).all() and len(unpack(pack(np.zeros(0)))[0]) == 0


def seatings(c):
    """All ways to part c customers, as lists of table sizes."""
    if c == 0:
        yield []
        return
    for s in seatings(c - 1):
        yield [*s, 1]
        for i in range(len(s)):
            yield [*s[:i], s[i] + 1, *s[i + 1 :]]


def test_stirling_numbers_count_seatings():
    d, table = 0.3, stirling(0.3)
    for c in range(1, 7):
        weight = Counter()
        for s in seatings(c):
            weight[len(s)] += math.prod(math.prod(range_from(1 - d, k - 1)) for k in s)
        assert all(abs(math.exp(table[c, t]) / w - 1) < 1e-9 for t, w in weight.items())


def range_from(x, n):
    return [x + i for i in range(n)]


def test_drawn_tables_follow_their_distribution():
    d, s, n = 0.4, 1.5, 200_000
    above = lambda at, j: np.full(len(at), (0.02, 0.1, 0.2, 0.3, 0.4)[j])
    drawn = draw_tables(np.full(n, 5), np.ones(n, dtype=np.int64), np.full(n, 8), d, s, above, np.random.default_rng(1))
    want = np.exp([stirling(d)[5, t] + sum(math.log((s + d * (7 + j)) * (0.02, 0.1, 0.2, 0.3, 0.4)[j]) for j in range(t)) for t in range(1, 6)])
    assert np.allclose(np.bincount(drawn, minlength=6)[1:] / n, want / want.sum(), atol=0.005)


def test_seating_bounds_and_spread():
    count = np.array([0, 1, 2, 40, EXACT + 1, 100_000])
    draw = lambda price: draw_tables(count, (count > 0).astype(np.int64), (count > 0).astype(np.int64), 0.5, 1.0, lambda at, j: np.full(len(at), price), np.random.default_rng(2))
    t = draw(0.3)
    assert t[0] == 0 and t[1] == 1 and (t <= count).all() and (t[1:] >= 1).all()
    assert (draw(1e12)[1:] > 0.99 * count[1:]).all()
    many = draw_tables(np.full(2000, 400), np.ones(2000, dtype=np.int64), np.ones(2000, dtype=np.int64), 0.5, 1.0, lambda at, j: np.full(len(at), 0.3), np.random.default_rng(3))
    assert np.var(many) > 0.3 * np.mean(many)  # real draws, not rounded means


def learned_counts():
    """Names by falling count and then hash, training counts of pairs of their numbers, documents as words between ends."""
    from pandas.util import hash_array

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    docs = [(d, held(d), ["\n", *tokens(t), "\n"]) for d, t in corpus()]
    pairs = Counter(p for _, out, ws in docs if not out for p in zip(ws, ws[1:]))
    total = Counter(w for _, out, ws in docs if not out for w in ws[1:])
    hashes = dict(zip(total, hash_array(np.array(list(total), dtype=object), categorize=False).view(np.int64).tolist()))
    names = sorted(total, key=lambda w: (-total[w], hashes[w]))
    at = {w: i for i, w in enumerate(names)}
    n = np.zeros((len(names), len(names)), dtype=np.int64)
    for (u, w), k in pairs.items():
        n[at[u], at[w]] = k
    share = lambda one, two: min(0.95, max(0.05, one / max(one + 2 * two, 1)))
    opened = (n > 0).sum(axis=0)
    model = Model(len(names), float(share((opened == 1).sum(), (opened == 2).sum())), 1.0, sweeps=[(float(opened.sum()), float(len(names)))])
    u, w = np.nonzero(n > 1)
    t_u, top = (n > 0).sum(axis=1), np.ones(len(names), dtype=np.int64)
    found = left_out((n == 1).sum(axis=1), n.sum(axis=1), t_u)
    found = found + left_out_repeated(n[u, w], n.sum(axis=1)[u], t_u[u], model.parent(opened, top, 0)[w])
    model.discount, model.strength = CHOICES[int(np.argmax(found))]
    return docs, at, n, model


def priced(docs, at, prob, above, unknown_after):
    """Scores of all documents from P(w | u), the parent's P(w), and the unknown word's probability after each word."""
    price = lambda u, w: (prob[at[u], at[w]] if u in at else above[at[w]]) if w in at else unknown_after[at.get(u, -1)]
    return {(-1 if d is None else d, len(ws)): sum(math.log10(price(*p)) for p in zip(ws, ws[1:])) for d, _, ws in docs}


def test_every_pair_counts(spark):
    """Scores equal those of a dense model in which every preceding word has a restaurant and the same draws are made."""
    docs, at, n, model = learned_counts()
    t, c, top = (n > 0).astype(np.int64), (n > 0).sum(axis=0), np.ones(len(at), dtype=np.int64)
    u, w = np.nonzero(n > 1)
    kept = []
    for sweep in (1, 2, 3):
        t[u, w] = model.draw_pairs(n[u, w], t[u, w], t.sum(axis=1)[u], c[w], top[w], sweep - 1, np.random.default_rng((1, sweep, 0)))
        before, c = model.sweeps[-1][1], t.sum(axis=0)
        top = model.draw_words(c, np.minimum(top, c), before, np.random.default_rng((2, sweep, 0)))
        model.sweeps.append((float(c.sum()), float(top.sum())))
        if sweep > 1:
            kept.append((t.copy(), c.copy(), top.copy(), sweep))
    n_u = n.sum(axis=1)
    back = lambda t: (model.strength + model.discount * t.sum(axis=1)) / (model.strength + n_u)
    prob = above = unknown = 0
    for t, c, top, k in kept:
        p, u0 = model.parent(c, top, k), model.parent(0, 0, k)
        each = (n - model.discount * t) / (model.strength + n_u)[:, None] + back(t)[:, None] * p[None, :]
        assert np.allclose(each.sum(axis=1) + back(t) * u0, 1) and abs(p.sum() + u0 - 1) < 1e-9
        prob, above, unknown = prob + each / 2, above + p / 2, unknown + np.append(back(t), 1) * u0 / 2
    want = priced(docs, at, prob, above, unknown)
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus()], SCHEMA).withColumn("held_out", crc_mod("doc_id", 10) == 0).repartition(3)
    got = {(-1 if r.doc_id is None else r.doc_id, r.n_tokens + 1): r.score for r in fit_and_score(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


class Restaurant:
    """Customers seated one by one, with the size of every table; the plainest sampler there is."""

    def __init__(self, d, s, parent, r):
        self.d, self.s, self.parent, self.r = d, s, parent, r
        self.tables, self.n, self.t = {}, 0, 0

    def p(self, w):
        mine = self.tables.get(w, [])
        return (sum(mine) - self.d * len(mine) + (self.s + self.d * self.t) * self.above(w)) / (self.s + self.n)

    def above(self, w):
        return self.parent.p(w) if isinstance(self.parent, Restaurant) else self.parent

    def add(self, w):
        mine = self.tables.setdefault(w, [])
        x = self.r.random() * (sum(mine) - self.d * len(mine) + (self.s + self.d * self.t) * self.above(w))
        self.n += 1
        for i, size in enumerate(mine):
            x -= size - self.d
            if x < 0:
                mine[i] += 1
                return
        mine.append(1)
        self.t += 1
        if isinstance(self.parent, Restaurant):
            self.parent.add(w)

    def remove(self, w):
        mine = self.tables[w]
        x = self.r.random() * sum(mine)
        i = 0
        while x >= mine[i]:
            x -= mine[i]
            i += 1
        mine[i] -= 1
        self.n -= 1
        if not mine[i]:
            del mine[i]
            self.t -= 1
            if isinstance(self.parent, Restaurant):
                self.parent.remove(w)


def test_scores_agree_with_a_sequential_sampler(spark):
    """Mean held-out and training scores are within 1 % of those of customer-by-customer Gibbs sampling."""
    import random

    docs, at, n, model = learned_counts()
    r = random.Random(4)
    top = Restaurant(model.parent_discount, model.parent_strength, 1 / (len(at) + 1), r)
    rooms = [Restaurant(model.discount, model.strength, top, r) for _ in at]
    customers = [(u, w) for u, w in zip(*np.nonzero(n)) for _ in range(n[u, w])]
    r.shuffle(customers)
    for u, w in customers:
        rooms[u].add(w)
    prob = above = unknown = 0
    for sweep in range(9):
        for u, w in customers:
            rooms[u].remove(w)
            rooms[u].add(w)
        if sweep > 3:
            prob = prob + np.array([[room.p(w) for w in range(len(at))] for room in rooms]) / 5
            above = above + np.array([top.p(w) for w in range(len(at))]) / 5
            unknown = unknown + np.array([*[room.p(-1) for room in rooms], top.p(-1)]) / 5
    want = priced(docs, at, prob, above, unknown)
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus()], SCHEMA).withColumn("held_out", crc_mod("doc_id", 10) == 0).repartition(3)
    rows = fit_and_score(df).collect()
    for out in (False, True):
        mine = [(x.score, want[-1 if x.doc_id is None else x.doc_id, x.n_tokens + 1]) for x in rows if x.held_out == out]
        assert abs(sum(a for a, _ in mine) / sum(b for _, b in mine) - 1) < 0.01


def test_gain_of_a_word_that_tells_the_next(spark):
    """Pairs of rare words are learned: the second is all but sure after the first, though neither is common."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"a{k} b{k}" for k in r.integers(0, 400, 30)) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("held_out", crc_mod("doc_id", 10) == 0)
    gain = {r.held_out: r.base_perplexity / r.perplexity for r in perplexity(fit_and_score(df)).collect()}
    assert gain[True] > 10
