import random

import numpy as np
from tokenizers import Tokenizer

from cohera.llm import tokens


def _both():
    path = tokens.default_path()
    library = Tokenizer.from_file(path)
    return tokens.counter(path), lambda s: len(library.encode(s, add_special_tokens=False).ids)


def test_every_prefix_counts_as_the_library_does():
    count, library = _both()
    rng = random.Random(3)
    letters = list("abcDE  \n\t\r'stlrevmd.,!=-_12é中😀  ñ")
    for k in range(250):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        s += rng.choice(["", "it'll", " 's", "\n's", "====" * 20, "    " * 9, "<|endoftext|>", "a<|endoftext|> b"])
        stored = count.differences(s)
        assert len(stored) == 2 * len(s)
        for p in range(1, len(s) + 1):
            assert tokens.tokens_at(stored, p) == library(s[:p]), (k, s, p)


def test_later_unicode_letters_follow_the_library():
    count, library = _both()
    for code in (0x088F, 0x0C5C, 0xA7CE, 0x107BB, 0x2EBF0, 0x0558):
        s = f"a{chr(code)}b 1{chr(code)}{chr(code)} !{chr(code)}\n{chr(code)}"
        assert tokens.tokens_at(count.differences(s), len(s)) == library(s), hex(code)


def test_budget_questions():
    count, library = _both()
    s = "The quick brown fox jumps over the lazy dog. " * 4
    stored = count.differences(s)
    for budget in (0, 1, 5, 17, 1000):
        n = tokens.longest_within(stored, budget)
        assert library(s[:n]) <= budget
        assert all(library(s[:m]) > budget for m in range(n + 1, len(s) + 1))


def test_rows(odd_docs, no_docs):
    _, library = _both()
    out = tokens.prefix_token_counts(odd_docs).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        text = r["text"] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == library(text)
        assert np.frombuffer(r["prefix_deltas"], "<i2").sum() == r["n_tokens"]
    assert tokens.prefix_token_counts(no_docs).count() == 0
    clash = odd_docs.withColumn("n_tokens", odd_docs["text"])
    assert dict(tokens.prefix_token_counts(clash).dtypes)["n_tokens"] == "bigint"


def test_query_answers_from_the_stored_prefixes(spark, sf_dir):
    _, library = _both()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = tokens.op1_token_counts(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 1024)
        assert r.fit_chars == len(t) if not r.over_limit else library(t[: r.fit_chars]) <= 1024 < library(t)
    assert set(tokens.within_budget(tokens.prefix_token_counts(spark.createDataFrame([("",), (None,)], "text string"))).toPandas().fit_chars) == {0}
