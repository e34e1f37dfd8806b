import random

from quarrylight.llm.toxicity import WordWeights, sample_and_train, score, sentences, train

SCHEMA = "doc_id bigint, text string, score string, extra int"


def corpus(n, seed):
    r = random.Random(seed)
    clean = [f"word{i}" for i in range(80)]
    bad = ["nasty", "vile", "foul"]
    texts, labels = [], []
    for _ in range(n):
        parts = [" ".join(r.choices(clean, k=8)) + "." for _ in range(r.randint(1, 6))]
        toxic = r.random() < 0.3
        if toxic:
            parts.insert(r.randrange(len(parts) + 1), " ".join([*r.choices(clean, k=3), r.choice(bad), *r.choices(clean, k=3)]) + "!")
        texts.append(" ".join(parts))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_location():
    model = train(*corpus(600, 1))
    weights = WordWeights(model)
    texts, labels = corpus(200, 2)
    scores = [weights.document(t) for t in texts]
    assert sum((s >= 0.5) == y for (s, _), y in zip(scores, labels)) >= 196
    for t, y, (s, each) in zip(texts, labels, scores):
        if y and s >= 0.5:
            worst = sentences(t)[max(range(len(each)), key=each.__getitem__)]
            assert any(w in worst for w in ("nasty", "vile", "foul"))
        clean = 1.0
        for p in each:
            clean *= 1 - p
        assert abs(s - (1 - clean)) < 1e-12


def test_scores_of_a_table(spark):
    texts, labels = corpus(400, 3)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, "", "x", None), (None, "vile foul nasty.", None, None), (0, texts[0], "x", 1), (902, "!!! ...", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*enumerate(labels), (0, None), (5, labels[5]), (None, 1)], "doc_id bigint, toxic int")
    model = sample_and_train(df, marks)
    out = score(df, model, locate=True)
    assert out.columns == ["doc_id", "text", "extra", "score", "sentences"]
    found = {(r.doc_id, r.text): r for r in out.collect()}
    assert found[900, None].score == 0.0 and found[901, ""].score == 0.0 and found[902, "!!! ..."].score < 0.5
    assert found[None, "vile foul nasty."].score > 0.5 and found[None, "vile foul nasty."].sentences[0].sentence == "vile foul nasty."
    assert all(0 <= r.score <= 1 for r in found.values()) and out.count() == len(rows)
    assert score(df.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1)], SCHEMA)
    model = sample_and_train(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert score(df, model).first().score < 0.5


def test_sample_keeps_the_share_of_toxic_rows(spark, monkeypatch):
    from quarrylight.llm import toxicity

    df = spark.createDataFrame([(i, f"word{i % 7} here.", "x", 1) for i in range(4000)], SCHEMA)
    marks = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(4000)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((len(texts), sum(labels))))
    for rows in (10_000, 1000):
        toxicity.sample_and_train(df, marks, sample_rows=rows)
    assert seen[0] == (4000, 200)
    assert 850 <= seen[1][0] <= 1150 and 0.03 <= seen[1][1] / seen[1][0] <= 0.07


def test_very_long_texts_and_clashing_names(spark):
    """A long text is scored whole: an offending sentence at its very end counts; the sample does not pass over long texts."""
    texts, labels = corpus(400, 5)
    long = " ".join(["word1 word2 word3."] * 40_000)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, long + " vile nasty foul!", long])], "doc_id bigint, text string, _made int")
    marks = spark.createDataFrame([*enumerate(labels), (400, 1)], "doc_id bigint, toxic int")
    model = sample_and_train(df, marks)
    found = {r.doc_id: r for r in score(df, model).collect()}
    assert found[400].score > 0.5 and found[400]["_made"] == 1 and found[400].score >= found[401].score
