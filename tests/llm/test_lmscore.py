import tracemalloc

import numpy as np

from cohera.llm import lmscore


def test_conditionals_sum_to_one():
    net = lmscore.Network.fresh(np.arange(lmscore.Network._TOTAL, dtype=float))
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape).astype(np.float32)
    ids = np.array([4352, 4352, 5, 77, 9, 4352, 4352])
    total = 0.0
    for w in range(lmscore.Network._TOTAL):
        ids[3] = w
        total += float(np.exp(net.log_probs(ids, np.array([3]))[0]))
    assert abs(total - 1) < 1e-3


def test_gradient(monkeypatch):
    monkeypatch.setattr(lmscore, "RATE", 1.0)
    net = lmscore.Network.fresh(np.ones(lmscore.Network._TOTAL))
    rng = np.random.default_rng(1)
    net.p = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 4352, 40)
    place = np.arange(2, 38)
    grads = {}
    net._step = lambda name, where, grad, memory: grads.setdefault(name, []).append((where, grad))
    net.train(ids, place, {})
    loss = lambda: -float(np.float64(net_log(net, ids, place)).mean())
    for name, (where, at) in {"cls": (..., (3, 5)), "bias": (..., (4,))}.items():
        g = dict((str(w), x) for w, x in grads[name])[str(where)][at]
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g) < 1e-3, name


def net_log(net, ids, place):
    return net.log_probs(ids, place)


def test_scores_follow_the_corpus(spark, no_docs, odd_docs):
    rng = np.random.default_rng(2)
    pat = ["the", "cat", "sat", "on", "mats"]
    rows = [(i, " ".join(pat * 30)) for i in range(300)] + [(1000, " ".join(rng.permutation(pat * 30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in lmscore.score(docs, lmscore.train(docs)).collect()}
    assert out[0].mean_log_likelihood > out[1000].mean_log_likelihood + 0.3
    assert out[0].n_tokens == 150 and abs(out[0].log_likelihood - 150 * out[0].mean_log_likelihood) < 1e-3
    model = lmscore.train(no_docs)
    assert lmscore.score(no_docs, model).count() == 0
    odd = lmscore.score(odd_docs, lmscore.train(odd_docs)).collect()
    assert len(odd) == odd_docs.count() and all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in odd)


def test_words_of_a_bucket_have_their_shares(spark):
    by, k = {}, 0
    while max(map(len, by.values()), default=0) < 3:
        by.setdefault(lmscore.zlib.crc32(b"r%d" % k) % lmscore.BUCKETS, []).append(f"r{k}")
        k += 1
    often, once, never = max(by.values(), key=len)
    common = " ".join(f"c{i}" for i in range(lmscore.KNOWN))
    docs = spark.createDataFrame([(1, " ".join([common] * 5)), (2, f"c1 c2 {often} c3 c4 {often} {often} {often} {once}")], "doc_id long, text string")
    model = lmscore.train(docs)
    asked = spark.createDataFrame([(w, f"c1 c2 {w} c3 c4") for w in (often, once, never)], "word string, text string")
    got = {r.word: r.log_likelihood for r in lmscore.score(asked, model).collect()}
    assert abs(got[often] - got[once] - np.log(4)) < 1e-6 and abs(got[once] - got[never]) < 1e-6
    number = model[0].number[often.encode()]
    assert number >= lmscore.KNOWN and abs(np.exp(model[0].log_total[number]) - (4 + 1 + 1)) < 1e-9


def test_model_grows_with_the_corpus():
    assert lmscore.sizes(400_000) == (lmscore.KNOWN, lmscore.CLASSES)
    known, classes = lmscore.sizes(4_000_000)
    total = known + lmscore.BUCKETS
    assert known > 1.5 * lmscore.KNOWN and total % classes == 0
    net = lmscore.Network.fresh(np.arange(total, dtype=float), classes=classes)
    ids = np.array([total, total, 5, 77, 9, total, total])
    probs = []
    for w in range(total):
        ids[3] = w
        probs.append(float(np.exp(net.log_probs(ids, np.array([3]))[0])))
    assert abs(sum(probs) - 1) < 1e-3


def test_document_score_worked_out_plainly(spark, monkeypatch):
    """Per token: class and word of the two-step softmax by plain loops, and a rare word's share of its bucket."""
    monkeypatch.setattr(lmscore, "HELD", 2)
    rng = np.random.default_rng(4)
    vocab = [f"c{i}" for i in range(lmscore.KNOWN)]
    rare = [f"r{i}" for i in range(12)]
    rows = [(0, " ".join(vocab * 3))] + [(i, " ".join([*rng.choice(vocab[:50], 30), *rng.choice(rare, 3 + i % 4)])) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary, net, shares = model = lmscore.train(docs)
    assert len(vocabulary.held[0]) == 2 and shares.count() > 0
    got = {r.doc_id: r.log_likelihood for r in lmscore.score(docs, model).collect()}
    counts = {}
    for _, text in rows:
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
    in_bucket = {}
    for w, n in counts.items():
        number = vocabulary.number[w.encode()]
        if number >= vocabulary.known:
            in_bucket[number] = in_bucket.get(number, 0) + n
    for i, text in rows[1:6]:
        words = text.split()
        ids = [vocabulary.outside] * 2 + [vocabulary.number[w.encode()] for w in words] + [vocabulary.outside] * 2
        total = 0.0
        for k, w in enumerate(words):
            x = net.p["bias"].astype(float)
            for j, off in enumerate((-2, -1, 1, 2)):
                x = x + net.p["emb"][j][ids[k + 2 + off]]
            h, t = np.tanh(x), ids[k + 2]
            c, m = divmod(t, net.per_class)
            for z, pick in ((h @ net.p["cls"] + net.p["cls_bias"], c), (h @ net.p["out"][c] + net.p["out_bias"][c], m)):
                total += z[pick] - np.log(np.exp(z).sum())
            if t >= vocabulary.known:
                total += np.log(counts[w] / (in_bucket[t] + 1))
        assert abs(got[i] - total) < 1e-2


def test_texts_are_read_twice(spark, sf_dir, monkeypatch):
    """Once to count words and once to number them; training and scoring go over the numbers."""
    kind, read = type(spark.range(1)), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (read.append("text" in self.columns), plain(self, *a, **k))[1])
    assert lmscore.op8_lm_scoring(spark, sf_dir).count() > 0
    assert sum(read) == 2


def test_softmax_is_formed_in_parts():
    """A batch's logits over all classes (16 MB here) are never held at once."""
    classes = 256
    net = lmscore.Network.fresh(np.ones(classes * 8), classes=classes)
    ids = np.random.default_rng(5).integers(0, classes * 8, lmscore.BATCH + 4)
    place, memory = np.arange(2, lmscore.BATCH + 2), net.memory()
    for run in (lambda: net.log_probs(ids, place), lambda: net.train(ids, place, memory)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10e6


def test_training_worked_out_plainly(monkeypatch):
    """One batch by plain loops, with classes whose logits may overflow exp() among others."""
    monkeypatch.setattr(lmscore, "ROWS", 7)
    rng = np.random.default_rng(6)
    net = lmscore.Network.fresh(rng.integers(1, 9, 40).astype(float), classes=5)
    net.p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    net.p["out"][2] *= 400
    assert [tame for _, tame in net.layers()] == [True, True, True, False, True, True]
    ids = np.r_[40, 40, rng.integers(0, 40, 60), 40, 40]
    place = rng.permutation(np.arange(2, 62))
    p, slope = {k: v.copy() for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    plain = {}
    for i in place:
        h = np.tanh(p["bias"] + sum(p["emb"][j][ids[i + off]] for j, off in enumerate((-2, -1, 1, 2))))
        c, m = divmod(ids[i], 8)
        dh, lp = np.zeros(len(h)), 0.0
        for name, at, pick in (("cls", ..., c), ("out", c, m)):
            z = h @ p[name][at] + p[f"{name}_bias"][at]
            z -= z.max()
            q = np.exp(z)
            lp += z[pick] - np.log(q.sum())
            q /= q.sum()
            q[pick] -= 1
            slope[name][at] += np.outer(h, q) / len(place)
            slope[f"{name}_bias"][at] += q / len(place)
            dh += p[name][at] @ q
        plain[i] = lp
        dx = dh * (1 - h * h) / len(place)
        slope["bias"] += dx
        for j, off in enumerate((-2, -1, 1, 2)):
            slope["emb"][j][ids[i + off]] += dx
    assert np.allclose(net.log_probs(ids, place), [plain[i] for i in place], rtol=1e-4, atol=1e-4)
    net.train(ids, place, net.memory())
    for k, g in slope.items():
        assert np.allclose(net.p[k], p[k] - lmscore.RATE * g / np.sqrt(1e-4 + g * g + 1e-8), atol=1e-6), k


def test_numbers_are_kept_whole(spark, odd_docs):
    """Stored numbers of odd texts, cut anywhere, give the words' numbers back."""
    texts = [r.text and r.text.encode() for r in odd_docs.select("text").collect()]
    for known in (20, 70_000):
        vocabulary = lmscore.Vocabulary([b"w%d" % i for i in range(known)], known)
        ids, n, _ = vocabulary.numbers(texts)
        ends = np.cumsum(n)
        stored = [ids[e - k : e].astype(vocabulary.kind).tobytes() for e, k in zip(ends, n, strict=True)]
        laid, place, doc = vocabulary.laid(stored)
        want = [(d, vocabulary.number[w]) for d, t in enumerate(texts) for w in lmscore.words(t)]
        assert list(zip(doc.tolist(), laid[place].tolist(), strict=True)) == want
        assert (np.delete(laid, place) == vocabulary.outside).all() and len(laid) == len(place) + 2 * (len(texts) + 1)
    rows = lmscore.number(odd_docs, vocabulary).collect()
    assert sorted(bytes(r.ids) for r in rows) == sorted(stored) and len({r["at"] for r in rows}) == len(texts)


def test_held_words_are_found_wherever_they_lie():
    rng = np.random.default_rng(7)
    words = [b"r%d" % i for i in range(3000)]
    counted = {w: int(n) for w, n in zip(words[:1000], rng.integers(2, 99, 1000), strict=True)}
    by_hash = sorted((int(np.uint64(lmscore.xxhash.xxh64_intdigest(w, 42)).view(np.int64)), np.log(n)) for w, n in counted.items())
    vocabulary = lmscore.Vocabulary([], 0, np.ones(lmscore.BUCKETS), (np.array([h for h, _ in by_hash]), np.array([x for _, x in by_hash])))
    asked = [words[i] for i in rng.integers(0, 3000, 5000)]
    logs, unheld, _ = vocabulary.shares(asked)
    assert unheld.tolist() == [w not in counted for w in asked]
    assert np.allclose(logs, [np.log(counted.get(w, 1)) for w in asked])
