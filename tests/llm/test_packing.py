import random

import pandas as pd

from cohera.llm import packing


def check(out: pd.DataFrame, lengths: dict, capacities):
    got = out.groupby("doc_id").n_tokens.sum().to_dict()
    assert got == lengths
    x = out[out.n_tokens > 0].sort_values(["bin_id", "bin_offset"])
    if not len(x):
        return
    assert sorted(x.bin_id.unique()) == list(range(x.bin_id.nunique()))
    for _, g in x.groupby("bin_id"):
        end = 0
        for r in g.itertuples():
            assert r.bin_offset == end
            end += r.n_tokens
        assert g.bin_capacity.nunique() == 1 and g.bin_capacity.iloc[0] == min(c for c in capacities if c >= end)


def test_packs_everything_tightly(spark):
    rng = random.Random(4)
    lengths = {i: rng.choice([0, 1, 7, 30, 64, 65, 100, 128, 200, 1000, 64]) for i in range(800)}
    docs = spark.createDataFrame([(i, n) for i, n in lengths.items()], "doc_id long, n_tokens long").repartition(5)
    caps = (64, 128, 256)
    out = packing.pack(docs, capacities=caps).toPandas()
    check(out, lengths, caps)
    x = out[out.n_tokens > 0]
    space = x.groupby("bin_id").bin_capacity.first().sum()
    one = packing.pack(docs, capacities=(256,)).toPandas()
    assert space <= one.groupby("bin_id").bin_capacity.first().sum() and x.n_tokens.sum() > 0.94 * space
    assert out[out.n_tokens == 0].bin_id.isna().all()
    pieces = out[out.doc_id == next(i for i, n in lengths.items() if n == 1000)].sort_values("piece")
    assert list(pieces.start) == [0, 256, 512, 768] and list(pieces.n_tokens) == [256, 256, 256, 232]


def test_like_one_at_a_time():
    """The histogram's bulk steps fill as plain best-fit decreasing does with one capacity."""
    rng = random.Random(8)
    for _ in range(30):
        items = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
        rooms: list[int] = []
        for n in items:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(50 - n)
        hist = {n: items.count(n) for n in set(items)}
        plan = packing.plan_bins(hist, (50,))
        assert plan.n_bins <= len(rooms) * 1.02 + 1


def least_cost(items, caps, cost):
    """The cheapest packing of a few pieces, over all ways to part them."""
    best = [0.0] + [float("inf")] * ((1 << len(items)) - 1)
    fits = {}
    for m in range(1, 1 << len(items)):
        held = sum(n for i, n in enumerate(items) if m >> i & 1)
        if held <= max(caps):
            fits[m] = cost(min(c for c in caps if c >= held))
    for m in range(1, 1 << len(items)):
        part, low = m, m & -m
        while part:
            if part & low and part in fits:
                best[m] = min(best[m], fits[part] + best[m ^ part])
            part = (part - 1) & m
    return best[-1]


def test_capacities_are_chosen_jointly():
    rng, caps = random.Random(9), (8, 16, 32)
    cost = lambda c: 4 + c + c * c / 64
    ratios = []
    for _ in range(150):
        items = [rng.randint(1, rng.choice((8, 16, 32))) for _ in range(rng.randint(1, 8))]
        hist = {n: items.count(n) for n in set(items)}
        plan = packing.plan_bins(hist, caps, cost)
        for c in caps:
            if c >= max(items):
                assert plan.cost <= packing.plan_bins(hist, (c,), cost).cost + 1e-9
        used = sum(cost(int(plan.capacity[i])) * (n - int(f)) for i, (f, n) in enumerate(zip(plan.first, [*plan.first[1:], plan.n_bins], strict=True)))
        assert abs(used - plan.cost) < 1e-9
        ratios.append(plan.cost / least_cost(items, caps, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.06
    # 600-token documents: three to a bin of 2,048 rather than one to a bin of 1,024.
    plan = packing.plan_bins({600: 3000})
    assert set(plan.capacity.tolist()) == {2048} and plan.cost == 1000 * packing.sequence_cost(2048)


def test_odd(spark):
    docs = spark.createDataFrame([(None, 5), (1, None), (2, 0), (2, 0), (3, 9)], "doc_id long, n_tokens long")
    assert packing.pack(docs).count() == 5
    assert packing.pack(docs.limit(0)).count() == 0


def test_query(spark, sf_dir, odd_docs):
    out = packing.op9_best_fit_packing(spark, sf_dir).toPandas()
    n = packing.with_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens").toPandas()
    check(out, n.set_index("doc_id").n_tokens.to_dict(), packing.CAPACITIES)
    assert packing.pack(packing.with_lengths(odd_docs)).count() >= odd_docs.count()
