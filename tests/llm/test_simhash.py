import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohera.llm import simhash


def slow_fingerprint(text, k=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_trie_finds_every_link():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:25]:
        for _ in range(12):
            b ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            values.add(b)
    v = np.array(sorted(values), np.uint64)
    i, j = simhash.trie_links(v, np.zeros(len(v), np.int64), 3)
    fps = {k: int(x) for k, x in enumerate(v)}
    want = components(fps)
    got = {k: k for k in fps}
    got.update(dict(zip(i.tolist(), j.tolist(), strict=True)))
    assert got == want and len(i) == len(set(want)) * 0 + len(fps) - len(set(want.values()))


def linked(df, **more):
    from cohera.operators.components import connected_components

    return {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, **more)).collect()}


def test_crowded_buckets_are_split(spark):
    rng = random.Random(7)
    near = {rng.getrandbits(48) << 16 | 7 for _ in range(300)} | {(5 << 40) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in near]
    df = spark.createDataFrame(rows, "fp long")
    whole = linked(df)
    assert whole == linked(df, most_in_bucket=100) and len(whole) >= 780


def test_no_dealt_key_exceeds_the_bound(spark):
    """20,000 fingerprints that share the first block's 16 bits: trie nodes of the other bits, joined pair by pair."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 48, 20_000, dtype=np.int64) << 16 | 7
    base[15_000:15_200] = base[:200] ^ (1 << rng.integers(16, 62, 200)) ^ (1 << rng.integers(16, 62, 200))
    fps = np.unique(base)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").withColumn("node", F.col("fp")).withColumn("wide", F.lit(None).cast("binary")).cache()
    dealt = simhash.dealt_buckets(df, 3, 1_000)
    most = dealt.groupBy("k", "side").count().agg(F.max("count")).first()[0]
    assert most <= 1_000
    got = linked(df, most_in_bucket=1_000)
    v = fps.view(np.uint64)
    want = set()
    for at in range(0, len(v), 500):  # brute force: all pairs
        i, j = np.nonzero(np.bitwise_count(v[at : at + 500, None] ^ v[None, :]) <= 3)
        want |= {(int(fps[at + a]), int(fps[b])) for a, b in zip(i, j, strict=True) if at + a < b}
    assert len(want) >= 150 and all(got[a] == got[b] for a, b in want)
    root = {x: x for pair in want for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}


def test_any_number_of_blocks_gives_the_same_links(spark, monkeypatch):
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(150)]
    values = sorted({b ^ sum(1 << x for x in rng.sample(range(63), rng.randint(0, 8))) for b in base for _ in range(4)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = linked(df, budget=5)
    for mean, r in ((-1, 4), (10**9, 1)):
        monkeypatch.setattr(simhash, "MEAN_BUCKET", mean)
        assert len(simhash.block_choices(len(values), 5)[1][0]) == r
        assert linked(df, budget=5) == want


def test_similarity_of_five_words(spark):
    """Texts with few words changed are linked, those under a similarity of 0.7 aren't, and equal copies always are."""
    rng, rows, like = random.Random(12), [], {}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = {}
    for k in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        for m, edits in enumerate((0, 0, 2, 4, 30)):
            own = list(words)
            for at in rng.sample(range(300), edits):
                own[at] = f"x{rng.randint(0, 10**6)}"
            i = k * 5 + m
            rows.append((i, " ".join(own)))
            sets[i] = {tuple(own[x : x + 5]) for x in range(296)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle_words=2, budget=7, wide_words=5).collect()}
    for k in range(60):
        for m in range(1, 5):
            j = jaccard(sets[k * 5], sets[k * 5 + m])
            like.setdefault("all" if j == 1 else "near" if j >= 0.85 else "far" if j < 0.7 else "edge", []).append(got[k * 5 + m] == got[k * 5])
    assert all(like["all"]) and not any(like["far"]) and sum(like["near"]) / len(like["near"]) > 0.9


def test_odd(spark, odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == odd_docs.count() and by[6][0].component_id == by[7][0].component_id == 6 and len(by[6]) == 2
    assert {r.component_id for k in (2, 3, 4) for r in by[k]} == {2} and by[2][0].fp == 0
    assert by[None][0].component_id is None
    assert simhash.near_duplicates(no_docs).count() == 0
