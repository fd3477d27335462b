import json

from pyspark.sql import functions as F

from cohera.operators import chunks, fim, graph
from cohera.sources import bundle, detect, parsers
from cohera.streaming.snapshots import watch_snapshots


def _write(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_bundle(spark, tmp_path):
    path = f"{tmp_path}/b"
    bundle.create_bundle(spark, path, "n", "s", "f")
    assert bundle.get_meta(spark, path)["schema_version"] == "1.2" and len(bundle.get_meta(spark, path)) == 5
    e = spark.createDataFrame([("a", "A", "law"), ("a", "again", "law"), ("b", "B", None)], "id string, title string, entry_type string")
    assert bundle.insert_or_ignore(spark, path, "entries", e) == 2
    assert bundle.insert_or_ignore(spark, path, "entries", e) == 0
    t = bundle.read_table(spark, path, "entries")
    assert t.filter("status = 'established'").count() == 2
    k = spark.createDataFrame([("x", "a", "b")], "link_type string, source_id string, target_id string")
    assert [bundle.insert_or_ignore(spark, path, "links", k) for _ in range(2)] == [1, 1]
    c = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "c", "y", 0.9), ("a", "c", "no link", 0.9), ("a", "d", "y", 0.1)], "source_id string, target_id string, link_type string, confidence double")
    assert bundle.insert_classified(spark, path, c, dry_run=True) == {"existing": 1, "inserted": 1, "no_link": 1, "low_confidence": 1}
    bundle.replace_table(spark, path, "cross_universe_bridges", spark.createDataFrame([("a", "w", 0.9)], "rrp_entry_id string, ds_entry_id string, similarity double"))
    assert bundle.read_table(spark, path, "cross_universe_bridges").count() == 1
    old = f"{tmp_path}/old"
    k.write.parquet(f"{old}/links")
    assert bundle.read_table(spark, old, "links").first().confidence_tier == "1.5"
    assert bundle.read_table(spark, old, "math_interpretations").count() == 0
    copy = bundle.backup(spark, path, str(tmp_path))
    assert bundle.read_table(spark, copy, "entries").count() == 2


def test_upsert(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    one = bundle.fisher_rows(fim.sweep(v, e), "s1", "g").withColumn("computed_at", F.lit("2026-01-01").cast("timestamp"))
    two = one.withColumns({"d_eff": F.lit(9), "computed_at": F.lit("2026-02-01").cast("timestamp")}).filter("entry_id = 'b'")
    out = {r.entry_id: r.d_eff for r in bundle.upsert(one, two).collect()}
    assert out["b"] == 9 and out["a"] is None and len(out) == 3


def test_detect(spark, tmp_path):
    cases = {"cobra_json": {"reactions": [], "metabolites": [], "genes": []}, "ro_crate": {"@context": 1, "@graph": []}, "frictionless": {"name": 1, "resources": []}, "flat_json": {"elements": [{"a": 1}]}, "unknown": {"a": 1}}
    for fmt, data in cases.items():
        assert detect.detect(spark, _write(tmp_path / f"{fmt}.json", data)) == fmt
    (tmp_path / "zoo").mkdir()
    for n in ("classes", "theorems"):
        _write(tmp_path / "zoo" / f"{n}.json", [])
    r = detect.detect_with_report(spark, str(tmp_path / "zoo"))
    assert r["format"] == "zoo_classes_json" and len(r["evidence"]) == 2
    (tmp_path / "x.pdf").write_bytes(b"")
    assert detect.detect(spark, str(tmp_path / "x.pdf")) == "paper_pdf"


def test_cobra(spark, tmp_path):
    met = lambda i: {"id": i, "name": i, "formula": "C", "charge": -1, "compartment": i[-1], "annotation": {}}
    data = {
        "reactions": [{"id": "PFK", "name": "Pfk", "subsystem": "s", "lower_bound": 0.0, "upper_bound": 1000.0, "gene_reaction_rule": "(b3916 or b1723) and b3916", "metabolites": {"atp_c": -1.0, "f6p_c": -1.0, "adp_c": 2.0}, "annotation": {"ec-code": ["2.7"]}},
                      {"id": "EX_a", "name": "", "lower_bound": -10.0, "upper_bound": 1.0, "gene_reaction_rule": "", "metabolites": {"atp_e": -1.0}, "annotation": {}}],
        "metabolites": [met(i) for i in ("atp_c", "f6p_c", "adp_c", "atp_e")], "genes": [{"id": g, "name": g, "annotation": {}} for g in ("b3916", "b1723")],
    }
    out = parsers.parse_cobra(spark, _write(tmp_path / "m.json", data))
    assert out["entries"].count() == 8
    kinds = {r.link_type: r.n for r in out["links"].groupBy("link_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"consumes": 3, "produces": 1, "catalyzed_by": 2, "same_metabolite": 1}
    st = out["sections"].filter("entry_id = 'rxn_PFK' and section_name = 'Stoichiometry'").first().content
    assert st == "atp_c + f6p_c -> 2 adp_c"
    assert out["entries"].filter("source_type = 'exchange_reaction'").count() == 1


def test_papers(spark, tmp_path):
    e = [{"id": i, "title": i, "entry_type": t, "paper": "p", "section": "1", "description": "d"} for i, t in (("a", "claim"), ("b", "method"), ("conclusions", "claim"))]
    data = {"metadata": {"title": "T", "papers": [{"id": "p", "title": "P", "authors": "A"}]}, "entries": e, "links": [{"source": "a", "target": "b", "type": "supports"}, {"source": "a", "target": "zz", "type": "supports"}]}
    path = _write(tmp_path / "p.json", data)
    c = parsers.parse_cluster(spark, path)
    assert c["links"].count() == 1 and c["skipped_links"].count() == 1 and c["papers"].count() == 1
    assert {r.id: (r.status, r.domain) for r in c["entries"].collect()}["a"] == ("proposed", "cosmology")
    p = parsers.parse_paper(spark, path)
    assert {r.id: r.status for r in p["entries"].collect()} == {"a": "superseded", "b": "established", "conclusions": "established"}
    old = {"meta": {"name": "o"}, "entries": [{"id": "x", "title": "X", "entry_type": "law", "sections": {"A": "1", "B": "2"}}], "links": [{"source": "x", "target": "x", "type": "refutes"}, {"source": "x", "target": "x", "type": "other"}]}
    o = parsers.parse_old_paper(spark, _write(tmp_path / "o.json", old))
    assert [r.section_order for r in o["sections"].orderBy("section_name").collect()] == [0, 1]
    assert sorted(r.confidence_tier for r in o["links"].collect()) == ["1.5", "2"]


def test_zoo(spark, tmp_path):
    _write(tmp_path / "classes.json", [{"name": "P", "desc": "d", "related": ["NP", "Nowhere"]}, {"name": "NP", "properties": ["x"], "related": ["P"]}])
    _write(tmp_path / "theorems.json", [{"name": "T", "content": "c", "impliedby": "P"}])
    _write(tmp_path / "conjectures.json", [{"name": "C", "content": "c", "implies": ["NP"], "not_implies": ["T"]}])
    _write(tmp_path / "problems.json", [{"name": "P"}])
    z = parsers.parse_zoo(spark, str(tmp_path))
    got = {(r.source_id, r.target_id): (r.link_type, r.confidence_tier) for r in z["links"].collect()}
    assert got == {("cls_P", "cls_NP"): ("analogous to", "1.5"), ("thm_T", "cls_P"): ("derives from", "1"), ("conj_C", "cls_NP"): ("predicts for", "1.5"), ("conj_C", "thm_T"): ("tensions with", "1.5")}
    assert z["entry_properties"].filter("property_name = 'unresolved_related' and property_value = 'Nowhere'").count() == 1


def test_elements_and_grid(spark, tmp_path):
    el = {"elements": [{"symbol": s, "name": s, "number": n, "category": c, "period": p, "group": g, "block": "s", "phase": "Gas", "atomic_mass": 1.0, "ionization_energies": [1312.0]} for s, n, c, p, g in (("H", 1, "diatomic nonmetal", 1, 1), ("He", 2, "noble gas", 1, 18), ("Li", 3, "alkali metal", 2, 1))]}
    out = parsers.parse_elements(spark, _write(tmp_path / "e.json", el))
    assert out["links"].count() == 2 and out["entry_properties"].filter("property_name = 'first_ionization_energy_kJ_mol' and property_value = '1312.0'").count() == 3
    assert {r.id: r.domain for r in out["entries"].collect()}["elem_He"] == "chemistry · physics"
    buses = spark.createDataFrame([(i, "pq" if i else "sl", 110.0, 1.0, 0.0) for i in range(4)], "idx int, type string, vn_kv double, vm_pu double, va_degree double")
    lines = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "from_bus int, to_bus int")
    gens = spark.createDataFrame([(0, 2, 10.0, 1.0)], "idx int, bus int, p_mw double, q_mvar double")
    g = parsers.parse_grid(buses, gens, lines, "case4")
    assert g["entries"].count() == 5 and g["links"].count() == 7
    assert parsers.grid_connected(buses, lines).first().connected and not parsers.grid_connected(buses, lines.limit(1)).first().connected
    assert graph.build_graph(g["entries"], g["links"]).count() == 4


def test_chunks(spark):
    e = spark.createDataFrame([("E1", "Law", "reference_law", "physics")], "id string, title string, entry_type string, domain string")
    s = spark.createDataFrame([("E1", "What It Claims", "c " * 40, 0), ("E1", "DS Cross-References", "no", 1), ("E1", "Mathematical Archetype", "first\n\nsecond", 2), ("E1", "Blank", "  ", 3), ("E1", "Notes", "[Supplemental x]\n\nnote", 4)], "entry_id string, section_name string, content string, section_order int")
    gates = spark.createDataFrame([("G1", "c", None, "b")], "id string, claim string, priority string, blocking string")
    out = {r.chunk_id: r for r in chunks.extract_chunks(e, s, gates=gates).collect()}
    assert set(out) == {"E1_What_It_Claims", "E1_Mathematical_Archetype", "E1_Notes", "gate_G1"}
    assert out["E1_Mathematical_Archetype"].embed_text.endswith("]\nfirst") and out["gate_G1"].embed_text == "Gate G1\nClaim: c\nBlocking: b"
    t = chunks.embed_texts(e, s).first().text
    assert t.startswith("reference_law: Law c c") and t.endswith(" note")
    v = chunks.embed(chunks.embed_texts(e, s)).first().vec
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def test_snapshot_stream(spark, tmp_path):
    schema = "snapshot_id string, chunk_id string, embedding array<float>"
    for k, v in enumerate(([1.0, 0.0], [0.0, 1.0])):
        spark.createDataFrame([(f"s{k}", "c", v)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = watch_snapshots(spark, f"{tmp_path}/in", f"{tmp_path}/latest", f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(120)
    got = sorted((r.batch, r.status, r.drift) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [x[1] for x in got] == ["new", "changed"] and got[1][2] == 1.0
