"""Known graphs and their spectra."""

import numpy as np
import pytest

from cohera.operators import fim, graph


def edges(spark, pairs, weight=1.0):
    rows = [(min(a, b), max(a, b), weight) for a, b in ((f"{a:03d}", f"{b:03d}") for a, b in pairs)]
    return spark.createDataFrame(rows, "a string, b string, weight double")


def vertices(spark, n):
    return spark.createDataFrame([(f"{i:03d}",) for i in range(n)], "id string")


def grid(k):
    return [(i * k + j, i * k + j + 1) for i in range(k) for j in range(k - 1)] + [(i * k + j, i * k + k + j) for i in range(k - 1) for j in range(k)]


@pytest.mark.parametrize(
    ("pairs", "n", "center", "alpha", "want"),
    [
        ([(i, i + 1) for i in range(9)], 10, 5, 3.0, (1, 1.2073, 0.10479)),
        ([(i, i + 1) for i in range(9)], 10, 5, 1.0, (1, 1.9893, 0.86351)),
        (grid(5), 25, 12, 1.0, (3, 3.6518, 0.49840)),
        (grid(5), 25, 12, 2.0, (1, 2.0494, 0.17654)),
        ([(i, (i + s) % 16) for i in range(16) for s in (1, 4)], 16, 0, 1.0, (1, 3.3296, 0.52033)),
        ([(i, j) for i in range(8) for j in range(i)], 8, 0, 1.0, (1, 1.6640, 0.04993)),
        ([(0, i) for i in range(1, 6)], 6, 0, 1.0, (1, 4.8435, 0.66946)),
    ],
)
def test_known_graphs(spark, pairs, n, center, alpha, want):
    got = fim.sweep(vertices(spark, n), edges(spark, pairs), alpha=alpha).filter(f"entry_id = '{center:03d}'").first()
    assert got.d_eff == want[0]
    assert abs(got.participation_ratio - want[1]) < 2e-4 and abs(got.disorder_index - want[2]) < 2e-5


def test_units():
    assert fim.decompose(np.eye(4))[1] == pytest.approx(4)
    x = np.array([1, 0.5, 0.1, 0.05])
    assert fim.decompose(np.outer(x, x))[0] == 1
    assert fim.decompose(np.zeros((2, 2)))[:2] == (1, 1.0)


def test_scores_are_clamped():
    center, nb = np.array([1.0, 1.0, 0.0, 0.0]), np.array([[1.0, 0.0, 1.0, 0.0]])
    _, _, _, _, raw = fim.spectrum_of(center, nb)
    assert raw[0] == pytest.approx(0.5 * 20.0**2)


def test_star_skips_leaves(spark):
    out = {r.entry_id: r for r in fim.sweep(vertices(spark, 7), edges(spark, [(0, i) for i in range(1, 6)])).collect()}
    assert len(out) == 7 and out["000"].regime == "noise_dominated"
    assert out["001"].skip_reason == "degree=1 < min_degree=2" and out["006"].center_degree == 0 and out["006"].regime == "degenerate"
    s = fim.sweep_summary(fim.sweep(vertices(spark, 7), edges(spark, [(0, i) for i in range(1, 6)]))).first()
    assert (s.n_analyzed, s.n_skipped) == (1, 6)


def test_two_universes(spark):
    e = lambda ids: spark.createDataFrame([(i, i) for i in ids], "id string, title string")
    k = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, confidence_tier string")
    b = spark.createDataFrame([("r1", "w1", 0.9), ("r2", "w2", 0.8), ("r3", "w1", 0.6)], "rrp_entry_id string, ds_entry_id string, similarity double")
    make = lambda least: graph.bridge_graph(e(["r1", "r2", "r3"]), k([("r1", "r2", "1"), ("r2", "r3", "1.5")]), e(["w1", "w2", "w3"]), k([("w1", "w2", "1"), ("w2", "w3", "2")]), b, least)
    v, edge = make(0.75)
    assert v.count() == 6 and edge.count() == 6 and make(0.0)[1].count() == 7 and make(1.0)[1].count() == 4
    out = {r.entry_id: r for r in fim.sweep(v, edge).collect()}
    for node, want in {"rrp::r1": (1, 1.019757, 0.009880), "rrp::r2": (2, 1.981920, 0.038082), "wiki::w1": (1, 1.019908, 0.009955), "wiki::w2": (2, 1.712420, 0.041094)}.items():
        r = out[node]
        assert (r.d_eff, round(r.participation_ratio, 6), round(r.disorder_index, 6)) == want
    assert out["rrp::r3"].skipped and out["wiki::w3"].skipped


def test_kernels_and_reasons(spark):
    v, e = vertices(spark, 4), edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    emb = spark.createDataFrame([(f"{i:03d}", [1.0, float(i)]) for i in range(4)], "id string, vec array<double>")
    for kernel in ("correlation", "weighted_hop"):
        assert fim.sweep(v, e, kernel, embeddings=emb).filter("skipped").count() == 0
        assert fim.sweep(v, e, kernel).filter("skip_reason like 'embeddings required%'").count() == 4
    few = fim.sweep(v, e, "correlation", embeddings=emb.filter("id <> '003'"))
    reasons = {r.entry_id: r.skip_reason for r in few.collect()}
    assert reasons == {"000": "no embedding for neighbor '003'", "001": None, "002": "no embedding for neighbor '003'", "003": "no embedding for '003'"}
    assert fim.sweep(v, e, "odd").first().skip_reason == "unknown kernel: odd"
    assert fim.analyze_node(v, e, "zzz").first().skip_reason == "node 'zzz' not in graph"


def test_parallel_links_and_unknown_ends(spark):
    v = vertices(spark, 3)
    links = spark.createDataFrame([("000", "001", None), ("001", "000", "1.5"), ("001", "009", "1"), ("001", "002", "odd")], "source_id string, target_id string, confidence_tier string")
    assert {(r.a, r.b): r.weight for r in graph.build_graph(v, links).collect()} == {("000", "001"): 1.5, ("001", "002"): 3.0}


def test_relaxation_agrees_with_the_heap(spark):
    v, e = vertices(spark, 9), edges(spark, grid(3)[:-2], 0.5)
    a = {(r.src, r.dst): r.d for r in graph.distances(v, e).collect()}
    assert a == {(r.src, r.dst): r.d for r in graph.relax_distances(e, v).collect()}
