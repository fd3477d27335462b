import corpus_pipeline as cp
from cohera.llm import decontam, quality, simhash, toxicity


def slow_components(fps):
    """Smallest id reachable by links, by comparing all pairs of distinct (two-word, wide five-word) fingerprints."""
    most = simhash.wide_budget(0.78)
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a[0] ^ b[0]).bit_count() <= 8 and (a[1] ^ b[1]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in fps.items():
        least[find(f)] = min(least.get(find(f), i), i)
    return {i: least[find(f)] for i, f in fps.items()}


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        before = {r.doc_id: r for r in docs.collect()}
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.doc_id for r in out.collect()]
        if k < 4:
            assert out.columns == docs.columns and len(after) == len(set(after)) and set(after) <= set(before), name
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if model.score((r.text or "").encode()) < 0.3}
        elif name == "quality rules":
            assert set(after) == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
        elif name.startswith("SimHash"):
            texts = {i: (r.text or "").encode() for i, r in before.items()}
            fps = {i: (simhash.fingerprint(t, 2) % (1 << 64), int.from_bytes(simhash.wide_fingerprint(t, 5), "big")) for i, t in texts.items()}
            assert set(after) == set(slow_components(fps).values())
        elif name.startswith("benchmark"):
            grams = {}
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = decontam.words(r.text.encode())
                for i in range(max(1, len(w) - 9)):
                    g = tuple(w[i : i + 10])
                    grams.setdefault(len(g), set()).add(g)

            def dirty(text, grams=grams):
                w = decontam.words((text or "").encode())
                return any(tuple(w[i : i + n]) in gs for n, gs in grams.items() for i in range(len(w) - n + 1))

            assert set(after) == {i for i, r in before.items() if not dirty(r.text)}
        else:
            assert set(after) == set(before)
        docs = out


def test_odd(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf_dir)
            assert k == 4 or out.columns == docs.columns
            assert out.count() <= max(1, docs.count()) * 20


def test_one_of_repeated_rows_stays(spark, odd_docs, sf_dir):
    kept = [r.doc_id for r in cp.drop_near_duplicates(spark, odd_docs, sf_dir).collect()]
    assert kept.count(6) == 1 and 7 not in kept and kept.count(None) == 1


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.count() > 50 and "bin_id" in out.columns
