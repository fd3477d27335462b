import math

import numpy as np

from cohera.llm import sharding


def whole_matrix(rows, cols, seed):
    ends = np.cumsum([0, *rows])
    return np.array([sharding.matrix_row(ends, cols, seed, p) for p in range(len(rows))])


def test_matrix_margins_and_law():
    rows, cols = [7, 0, 5, 20, 1], sharding.shard_sizes(33, 5)
    m = whole_matrix(rows, cols, 1)
    assert (m.sum(1) == rows).all() and (m.sum(0) == cols).all() and (m >= 0).all()
    draws = np.array([whole_matrix([2, 2], np.array([2, 2]), seed)[0, 0] for seed in range(3000)])
    want = np.array([1, 4, 1]) / 6  # hypergeometric: 2 of 4
    assert np.abs(np.bincount(draws, minlength=3) / 3000 - want).max() < 0.04


def test_large_draws_follow_the_exact_law():
    rng = np.random.default_rng(3)
    for good, bad, n in ((30, 50, 25), (3, 4, 5), (1, 9, 4), (200, 5, 100)):
        draws = np.bincount([sharding.draw_large(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1) / 20_000
        want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)])
        assert np.abs(draws - want).max() < 0.015
    # 10^9 of 2 x 10^9, half of them good: a standard deviation of 11,180, not the binomial's 15,811.
    got = np.array([sharding.draw_large(rng, 10**9, 10**9, 10**9) for _ in range(4000)], float)
    assert abs(got.std() / 11_180.3 - 1) < 0.04 and abs(got.mean() - 5e8) < 4 * 11_180 / 4000**0.5
    split = sharding.draw_split(rng, np.full(16, 5 * 10**8), 3 * 10**9)
    assert split.sum() == 3 * 10**9 and np.abs(split - 3 * 10**9 / 16).max() < 1e5


def test_exact_shards(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    df = spark.range(1003).repartition(7)
    out = sharding.shuffle_to_shards(df, 8).toPandas()
    assert sorted(out.id) == list(range(1003))
    sizes = out.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.shuffle_to_shards(df, 8).toPandas()
    assert out.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    assert abs(np.corrcoef(out.id, out.shard)[0, 1]) < 0.15
    assert sharding.shuffle_to_shards(no_docs, 8).count() == 0
    odd = sharding.shuffle_to_shards(odd_docs, 8)
    assert odd.count() == odd_docs.count() and dict(odd.dtypes)["shard"] == "int" and "_cell" in odd.columns


def test_uniform_over_seeds(spark):
    """Chi-square of rows by (shard, slot): over 400 rows and 12 seeds."""
    df = spark.range(400).repartition(3).cache()
    seen = np.zeros((400, 8))
    for seed in range(12):
        out = sharding.shuffle_to_shards(df, 4, seed=seed).toPandas()
        np.add.at(seen, (out.id, out.shard * 2 + out.slot // 50), 1)
    assert (seen.sum(1) == 12).all()
    chi = ((seen - 1.5) ** 2 / 1.5).sum()
    free = 399 * 7
    assert abs(chi - free) < 4 * (2 * free) ** 0.5


def test_query(spark, sf_dir):
    out = sharding.op6_sharding(spark, sf_dir).toPandas()
    assert set(out.law) == {"rows"} and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
