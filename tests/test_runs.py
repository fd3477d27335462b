import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera import cli
from cohera.operators import fim, graph, prompts, report, snapshots, vectors
from cohera.plans import runs
from cohera.sources import bundle


def _filled(spark, path, names, text="a law of the conservation of energy in closed systems, {}, and what follows from it"):
    bundle.create_bundle(spark, path, "b", "s", "f")
    bundle.insert_or_ignore(spark, path, "entries", spark.createDataFrame([(n, n.upper(), "law") for n in names], "id string, title string, entry_type string"))
    sections = [(n, "What It Claims", text.format(n) if n != "thin" else "x") for n in names]
    bundle.insert_or_ignore(spark, path, "sections", spark.createDataFrame(sections, "entry_id string, section_name string, content string"))


def test_bridge_run(spark, tmp_path):
    own, kb = str(tmp_path / "own"), str(tmp_path / "kb")
    _filled(spark, own, ["a", "b", "thin"])
    _filled(spark, kb, ["x", "y", "z", "u"])
    known = bundle.open_bundle(spark, kb)
    swept = spark.createDataFrame([(n, 0.2 if n in "xy" else 0.9, "isotropic", False) for n in "xyzu"], "entry_id string, disorder_index double, regime string, skipped boolean")
    stats = [runs.bridge_run(spark, own, known, threshold=0.5, kb_sweep=swept) for _ in range(2)]
    assert stats[0] == stats[1] and stats[0]["total_entries"] == 3 and stats[0]["queried"] == 2 and stats[0]["skipped_thin"] == 1
    stored = bundle.read_bridges(spark, own).collect()
    assert len(stored) == stats[0]["bridges_stored"] == 6 and stats[0]["entries_with_bridge"] == 2
    assert stats[0]["fisher_trusted"] == sum(r.ds_entry_id in "xy" for r in stored) and {r.rrp_entry_title for r in stored} == {"A", "B"}
    assert bundle.get_meta(spark, own)["pass2_status"].startswith("bridges=6 ")


def test_missing_bridges_are_an_error(spark, tmp_path):
    spark.createDataFrame([("a",)], "id string").write.parquet(f"{tmp_path}/entries")
    with pytest.raises(ValueError, match="cross_universe_bridges"):
        bundle.read_bridges(spark, str(tmp_path))
    assert bundle.read_table(spark, str(tmp_path), "links").count() == 0


def test_of_a_repeated_key_the_first_row_is_kept(spark, tmp_path):
    path = str(tmp_path)
    bundle.create_bundle(spark, path, "b", "s", "f")
    rows = [(f"k{i % 40}", f"title {i:03d}") for i in range(400)]
    assert bundle.insert_or_ignore(spark, path, "entries", spark.createDataFrame(rows, "id string, title string").coalesce(3)) == 40
    assert {r.id: r.title for r in bundle.read_table(spark, path, "entries").collect()} == {f"k{i}": f"title {i:03d}" for i in range(40)}


def test_large_and_long_graphs(spark, monkeypatch):
    """Beyond the broadcast bound distances come from relaxation, directed ones too, whatever the paths' lengths."""
    v = spark.range(24).select(F.col("id").cast("string"))
    e = spark.createDataFrame([(str(i), str(i + 1), 1.0 + i % 3) for i in range(23)] + [("5", "2", 0.5)], "a string, b string, weight double")
    for directed in (False, True):
        for weighted in (False, True):
            want = sorted(map(tuple, graph.distances(v, e, directed, weighted).collect()))
            monkeypatch.setattr(graph, "MOST_BROADCAST_EDGES", 3)
            assert sorted(map(tuple, graph.distances(v, e, directed, weighted).collect())) == want
            monkeypatch.undo()


def test_converging_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    old, new = rng.normal(size=(2, 40, 6))
    old[3] = 0
    frame = lambda m: spark.createDataFrame([(f"c{i:02d}", [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id string, embedding array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    gain = unit(new) @ unit(new).T - unit(old) @ unit(old).T
    want = sorted(((round(float(gain[i, j]), 4), f"c{i:02d}", f"c{j:02d}") for i in range(40) for j in range(i + 1, 40) if 3 not in (i, j)), reverse=True)[:5]
    assert [(r.gain, r.id, r.other) for r in snapshots.converging(frame(old), frame(new)).collect()] == want


def test_unread_answers_are_no_link(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    kind = sorted(prompts.LINK_TYPES)[0]
    answer = json.dumps([{"pair": 1, "link_type": kind, "confidence": 0.9, "reason": "r"}, {"pair": 7, "link_type": kind, "confidence": 1.0, "reason": "no such pair"}])
    rows = spark.createDataFrame([(pairs, answer), ([("x", "y")], "not json")], "pairs array<struct<id:string,other:string>>, answer string")
    got = {(r.source_id, r.target_id): (r.link_type, r.confidence) for r in prompts.read_answers(rows).collect()}
    assert got == {("a", "b"): (prompts.NO_LINK, 0.0), ("b", "c"): (kind, 0.9), ("c", "d"): (prompts.NO_LINK, 0.0), ("x", "y"): (prompts.NO_LINK, 0.0)}


def test_rerank_orders_and_keeps_similarity(spark):
    c = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7)], "id int, entry_id string, similarity double")
    s = spark.createDataFrame([(1, "b", -2.0), (1, "a", -5.0)], "id int, entry_id string, score double")
    got = {r.entry_id: (r.rerank_rank, r.similarity, r.rerank_score) for r in vectors.rerank(c, s).collect()}
    assert got == {"b": (0, 0.8, -2.0), "a": (1, 0.9, -5.0), "c": (2, 0.7, None)}


def test_text_table_says_what_it_leaves_out(spark):
    lines = report.text_table(spark.range(60).orderBy(F.desc("id")), most=5).split("\n")
    assert lines[1:] == ["0", "1", "2", "3", "4", "... and 55 more rows"]


def test_verbs(spark, tmp_path, capsys):
    own, kb = str(tmp_path / "own"), str(tmp_path / "kb")
    _filled(spark, own, ["a", "b"])
    _filled(spark, kb, ["x", "y", "z"])
    bundle.insert_or_ignore(spark, kb, "links", spark.createDataFrame([("couples to", "x", "y"), ("couples to", "y", "z"), ("couples to", "z", "x")], "link_type string, source_id string, target_id string"))
    cli.main(["sync", own, kb, "--min-sim", "0.5"])
    assert json.loads(capsys.readouterr().out)["bridges_stored"] == 6
    cli.main(["wiki", kb, "--format", "json"])
    assert json.loads(capsys.readouterr().out)
    cli.main(["resolve", kb, "the conservation of energy in closed systems"])
    assert "entry_id" in capsys.readouterr().out
    assert fim.sweep(bundle.read_table(spark, kb, "entries"), graph.build_graph(*(bundle.read_table(spark, kb, t) for t in ("entries", "links")))).count() == 3
