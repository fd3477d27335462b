import numpy as np

from cohera.llm import toxicity


def test_weights_are_sparse_and_learn_words():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 80)) + (" awful brute" if k % 5 == 0 else "") for k in range(600)]
    labels = np.array([int(k % 5 == 0) for k in range(600)])
    model = toxicity.fit([t.encode() for t in texts], labels)
    assert 0 < len(model.weights) < 0.01 * 600 * 80
    assert model.score(b"w1 w2 awful brute w3") >= 0.3 > model.score(b"w1 w2 w3 w4")


def test_skip_grams_count():
    a, b = toxicity.features(b"one two three"), toxicity.features(b"one four three")
    assert len(set(a) & set(b)) == 3  # two words and the pair around one
    assert len(toxicity.features(b"")) == 0 and len(toxicity.features(b"one")) == 1


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.op7_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    hit, miss = ((test.predicted == 1) & (test.toxic == 1)).sum(), ((test.predicted == 1) & (test.toxic == 0)).sum()
    assert hit >= 0.5 * test.toxic.sum() and miss <= 2 and test.score.between(0, 1).all()


def test_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels.limit(0))).count() == 0
