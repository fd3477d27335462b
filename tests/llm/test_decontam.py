import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cohera.llm import decontam
from cohera.plans.shared import placed


def brute(text, items, width):
    w, hits, found = decontam.words((text or "").encode()), set(), set()
    for i, t in items:
        b = decontam.words((t or "").encode())
        for k in range(max(1, len(b) - width + 1)) if b else ():
            g = b[k : k + width]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hits |= set(range(s, s + len(g)))
                    found.add(str(i))
    return len(w), sorted(hits), sorted(found)


def test_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(9)] + ["É", "x-y"]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, item(12)), (2, item(3)), (3, ""), (4, None), (5, item(5)), (6, "One"), (10, item(6))]
    docs = [(k, item(rng.randint(0, 60)) + rng.choice(["", " " + items[0][1], " " + items[1][1].upper(), " one"])) for k in range(40)] + [(90, None), (91, ""), (None, items[0][1]), (7, "w1"), (7, "w1")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for width, block in ((4, 40), (10, 500_000)):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        got = sorted((repr(r.doc_id), r.text or "", r.n_words, r["hits"], r["items"]) for r in decontam.decontaminate(d, b, width).collect())
        want = sorted((repr(i), t or "", *brute(t, items, width)) for i, t in docs)
        assert got == want, (width, block)


def test_numbers_come_back():
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**31 - 1, 5])
    data, sizes = decontam.encode(x)
    assert decontam.decode(data).tolist() == x.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 5, 1]


def test_stored_postings(spark, sf_dir):
    """The index read back gives every position of every term, sorted by term; phrases and proximity agree with brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = placed(docs)
    index = decontam.build_index(rows.select("_at", "text"))
    assert sum(r.n for r in index.filter("length(term) > 0").select("n").collect()) == sum(len(decontam.words((r.text or "").encode())) for r in docs.collect())
    text = {tuple(r._at): decontam.words((r.text or "").encode()) for r in rows.collect()}
    blocks = {}
    for r in index.collect():
        blocks.setdefault(r.block, {})[bytes(r.term)] = bytes(r.data)
    for own in blocks.values():
        layout = np.frombuffer(own.pop(b""), np.int64).reshape(-1, 4).tolist()
        flat = [w for file, row, _, n in layout for w in text[file, row]]
        assert sum(n for *_, n in layout) == len(flat)
        back = {t: np.cumsum(decontam.decode(np.frombuffer(c, np.uint8))).tolist() for t, c in own.items()}
        want = {}
        for at, w in enumerate(flat):
            want.setdefault(w, []).append(at)
        assert back == want
    files = {}
    for r in index.select(F.col("_metadata.file_path").alias("f"), "term", "block").collect():
        files.setdefault(r.f, []).append((r.block, bytes(r.term)))
    assert all(x == sorted(x) for x in files.values())


def test_proximity_by_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(30)]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    items = [(i, " ".join(rng.sample(vocab, 3))) for i in range(12)]
    count = Counter(w for _, t in docs for w in t.split())
    want = {}
    for k, t in docs:
        own = t.split()
        want[k] = sorted(str(i) for i, item in items for rare in [min(item.split(), key=lambda w: (count[w], item.split().index(w)))]
                         if any(own[p] == rare and all(w in own[max(0, p - 4) : p + 5] for w in item.split()) for p in range(len(own))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.near_items for r in decontam.decontaminate(d, b, proximity=4).collect()} == want


def test_no_benchmark_is_broadcast(spark):
    """With Spark's own small-table broadcast off, no plan of the search has a broadcast: the benchmark stays distributed."""
    d = placed(spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string"))
    index = decontam.build_index(d.select("_at", "text"))
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        windows = decontam.windows_of(b)
        ranked = decontam.ranked_windows(index, windows)
        for df in (index.join(windows.selectExpr("explode(terms) AS term"), "term", "left_semi"), ranked, decontam.candidates(index, ranked), decontam.phrase_hits(index, b)):
            assert "Broadcast" not in df._jdf.queryExecution().toString()
        assert decontam.phrase_hits(index, b).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x x green x blue"), (2, "red " + "x " * 30 + "green blue"), (3, "green blue red")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    out = {r.doc_id: (r["items"], r["near_items"]) for r in decontam.decontaminate(d, b, 10, proximity=5).collect()}
    assert out == {1: ([], ["1"]), 2: ([], []), 3: ([], ["1"])}


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(tuple(r) for r in decontam.op5_decontamination(spark, sf_dir).collect()) == sorted(con.sql(decontam.OP5_SQL).fetchall())


def test_odd(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "same text twice"), (None, "alpha beta")], "item_id long, text string")
    out = decontam.decontaminate(odd_docs, b).collect()
    assert sum(r["items"] == ["1"] for r in out) == 3 and len(out) == odd_docs.count()
    assert decontam.decontaminate(no_docs, b).count() == 0
    assert {tuple(r["hits"]) for r in decontam.decontaminate(odd_docs, b.limit(0)).collect()} == {()}
