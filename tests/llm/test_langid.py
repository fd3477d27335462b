import numpy as np

from cohera.llm import langid


def conditional(words, counts, order, discount):
    """p(character | context) of interpolated Kneser-Ney, by dictionaries."""
    from collections import defaultdict

    grams = [defaultdict(float) for _ in range(order + 1)]
    marked = [(f"\x02{w}\x03", c) for w, c in zip(words, counts, strict=True)]
    for w, c in marked:
        for e in range(1, len(w)):
            for n in range(1, order + 1):
                if e - n + 1 >= 0:
                    grams[n][w[e - n + 1 : e + 1]] += c
    real = [dict(g) for g in grams]
    for n in range(1, order):
        for g in grams[n]:
            if not g.startswith("\x02"):
                grams[n][g] = sum(1 for h in real[n + 1] if h.endswith(g))
    alphabet = len(grams[1]) + 1

    def p(ctx, c, n):
        if n == 0:
            return 1 / alphabet
        own = {g: v for g, v in grams[n].items() if g[:-1] == ctx}
        if not own:
            return p(ctx[1:], c, n - 1)
        total = sum(own.values())
        return max(own.get(ctx + c, 0) - discount, 0) / total + discount * len(own) / total * p(ctx[1:], c, n - 1)

    return p


def naive(words, counts, order, discount, word):
    p = conditional(words, counts, order, discount)
    w = f"\x02{word}\x03"
    return sum(np.log(p(w[max(0, e - order + 1) : e], w[e], min(order, e + 1))) for e in range(1, len(w)))


def test_model_is_interpolated_kneser_ney():
    words, counts = ["the", "then", "hat", "that", "ñu"], np.array([5, 2, 1, 3, 1])
    model = langid.KneserNey(words, counts, order=3)
    for w in ("the", "hath", "zzz", "ñt", "a"):
        got = model.score(langid._grams([w], 3), 1)[0]
        assert abs(got - naive(words, counts, 3, 0.75, w)) < 1e-4, w


def test_probabilities_sum_to_one():
    """Over the characters seen and one that wasn't, in contexts that were seen and one that wasn't."""
    words, counts = ["aba", "abc", "ca"], np.array([2, 1, 1])
    p = conditional(words, counts, 3, 0.75)
    for ctx in ("", "a", "ab", "\x02a", "c", "zz"):
        assert abs(sum(p(ctx, c, len(ctx) + 1) for c in ["a", "b", "c", "\x03", "z"]) - 1) < 1e-9, ctx
    model = langid.KneserNey(words, counts, order=3)
    for word in ("ab", "cab", "za"):
        assert abs(model.score(langid._grams([word], 3), 1)[0] - naive(words, counts, 3, 0.75, word)) < 1e-4


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 20 and (out.lang_pred == out.lang).mean() >= 0.95
    assert out.score.between(0, 1).all()


def test_rows(spark, odd_docs, no_docs):
    model = langid.Identifier({"en": langid.KneserNey(["alpha", "beta"], np.array([3, 2])), "fr": langid.KneserNey(["été", "deux"], np.array([3, 2]))})
    out = langid.identify(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        has = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not has) and 0 <= r["score"] <= 1
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty).collect()} == {"und"}
    langid.identify(odd_docs, langid.train(odd_docs)).count()


def test_every_language_is_calibrated(spark):
    rows = [(i, f"the cat sat on mats {i % 7}", "en") for i in range(4_000)] + [(i, f"le chat est sur la table {i % 7}", "fr") for i in range(4_000, 8_000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.limits) == {"en", "fr"}
    rare = [r for r in rows if r[0] < 4_040]
    model = langid.train(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    assert set(model.limits) == {"en", "fr"}  # 40 rows of one language, 4,000 of the other
    docs = spark.createDataFrame([("zzxq wvvz qqkk xxjz",)], "text string")
    assert langid.identify(docs, langid.Identifier(model.models, model.curve, {"en": 2.0})).first()["rejected"]
