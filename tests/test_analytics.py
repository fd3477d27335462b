"""Coverage, gaps, bridges, claims, layout and patterns on small fixtures."""

from cohera.operators import bridges, charts, claims, coverage, gaps, layout, patterns, vectors


def _cov(spark):
    kinds = {"RL1": "physics", "RL2": "physics", "RL3": "biology", "RL4": "physics", "RL5": "chemistry"}
    rows = [(i, i, "reference_law", d) for i, d in kinds.items()] + [("L1", "L1", "law", "physics"), ("L2", "L2", "law", "biology"), ("OQ1", "OQ1", "open question", "physics")]
    e = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, entry_type string, domain string, source_type string")
    s = {i: "yes" for i in ("RL1", "RL2", "RL4", "L1", "L2")} | {"RL3": "no", "RL5": "No"}
    p = [(i, "dimensional_sensitivity", v) for i, v in s.items()] + [(i, "concept_tags", "t") for i in ("RL1", "RL2", "RL3", "RL4", "L1", "L2")] + [("OQ1", "concept_tags", "")]
    p += [(r[0], "mathematical_archetype", a) for r, a in zip(rows, ("sq", "sq", "diff", "bound", "decay", "dim", "dim", "eq"), strict=True)]
    k = [("derives from", "L1", "RL1", "2"), ("generalizes", "L2", "RL3", "1.5"), ("analogous to", "RL1", "RL2", None)]
    return e, spark.createDataFrame(k, "link_type string, source_id string, target_id string, confidence_tier string"), spark.createDataFrame(p, "entry_id string, property_name string, property_value string")


def test_coverage(spark):
    e, k, p = _cov(spark)
    cov = {r.property_name: r.coverage_pct for r in coverage.property_coverage(e, p).collect()}
    assert cov == {"dimensional_sensitivity": 87.5, "concept_tags": 75.0, "mathematical_archetype": 100.0}
    n = coverage.network_metrics(e, k).first()
    assert (n.link_density, n.avg_links, n.isolated_count) == (round(3 / 28, 6), 0.38, 3)
    assert {r.id for r in coverage.isolated(e, k).collect()} == {"RL4", "RL5", "OQ1"}
    assert {r.value: r.n for r in coverage.sensitivity(e, p).collect()} == {"yes": 5, "no": 2, "missing": 1}
    assert {r.value: r.n for r in coverage.distribution(k, "confidence_tier", "original").collect()} == {"2": 1, "1.5": 1, "original": 1}
    texts = {(r.rule, r.subject) for r in coverage.gap_texts(e, k, p).collect()}
    assert {(1, "concept_tags"), (1, "dimensional_sensitivity"), (3, "some"), (5, "open question")} <= texts
    empty = e.limit(0)
    assert coverage.network_metrics(empty, k.limit(0)).first().link_density == 0


def test_gaps(spark):
    rows = [(f"E{i}", "reference_law", "physics") for i in range(1, 6)] + [("M1", "method", "cs"), ("M2", "method", "cs"), ("Q1", "open_question", "physics")]
    e = spark.createDataFrame([(i, i, t, d, "x") for i, t, d in rows], "id string, title string, entry_type string, domain string, source_type string")
    p = [(i, "mathematical_archetype", "conservation-law") for i in ("E1", "E2", "E3")] + [("M2", "mathematical_archetype", "oscillatory"), ("E1", "concept_tags", "x")]
    p += [(i, "dimensional_sensitivity", "D-sensitive") for i in ("E1", "E2", "E4", "E5")] + [(i, "dimensional_sensitivity", "D-invariant") for i in ("E3", "M2")]
    p = spark.createDataFrame(p, "entry_id string, property_name string, property_value string")
    k = spark.createDataFrame([("derives from", "E1", "E2", "1"), ("couples to", "E3", "E4", "1.5"), ("tests", "Q1", "M1", "2")], "link_type string, source_id string, target_id string, confidence_tier string")
    g = {(r.entity_type if "entity_type" in r else r.entry_type, r.property_name): r for r in gaps.property_gaps(e, p).collect()}
    r = g[("reference_law", "mathematical_archetype")]
    assert (r.coverage_pct, r.missing_ids, r.priority) == (60.0, ["E4", "E5"], 2)
    assert {x.entry_id: x.gap_type for x in gaps.link_gaps(e, k).collect()} == {"E5": "isolated", "M2": "isolated", "E3": "no_tier1", "E4": "no_tier1", "Q1": "no_tier1", "M1": "no_tier1"}
    assert {x.entity_type: x.deficit for x in gaps.type_balance_gaps(e).collect()} == {"reference_law": 45, "method": 8, "open_question": 9}
    ranks = gaps.enrichment_priorities(e, k, p).orderBy("rank").collect()
    assert [x.rank for x in ranks] == list(range(1, len(ranks) + 1)) and ranks[0].impact_score >= ranks[-1].impact_score


def test_domains(spark):
    b = spark.createDataFrame(
        [("R1", "TD3", "couples to", "chemistry", "physics"), ("R1", "BIO1", "derives from", "chemistry", "biology"), ("R2", "BIO1", "derives from", "formal logic", "biology"), ("R2", "MATH4", "analogous to", "formal logic", "mathematics"), ("R3", "X", None, None, None)],
        "rrp_entry_id string, ds_entry_id string, proposed_link_type string, source_domain string, target_domain string",
    )
    c = bridges.check_domains(b)
    assert [r.rrp_entry_id + r.ds_entry_id for r in c.filter("status = 'warning'").collect()] == ["R2BIO1"]
    s = bridges.domain_summary(c).first()
    assert (s.total, s.n_valid, s.n_warning, s.n_violation, s.domain_coverage) == (5, 4, 1, 0, ["biology", "mathematics", "physics"])


def test_trust(spark):
    sweep = spark.createDataFrame([("PHYS1", 0.30, "radial_dominated", False), ("BIO1", 0.62, "isotropic", False), ("SOFT1", 0.72, "noise_dominated", False)], "entry_id string, disorder_index double, regime string, skipped boolean")
    b = spark.createDataFrame([("r", x, 0.9) for x in ("PHYS1", "BIO1", "SOFT1", "NONE")], "rrp_entry_id string, ds_entry_id string, similarity double")
    for tier, ok in ((1, {"PHYS1"}), (2, {"PHYS1", "BIO1"}), (3, {"PHYS1", "BIO1", "SOFT1"})):
        tiers = spark.createDataFrame([(x, tier) for x in ("PHYS1", "BIO1", "SOFT1")], "id string, formality_tier int")
        out = {r.ds_entry_id: r for r in bridges.score_bridges(b, sweep, tiers).collect()}
        assert {k for k, r in out.items() if r.structured} == ok and out["NONE"].trust == 0 and out["NONE"].regime == "degenerate"
        if tier == 1:
            assert abs(out["PHYS1"].trust - 0.63) < 1e-9


def test_claims(spark):
    t = "We find that A is consistent with B at 3σ level. See Fig. Two for details. The model, however, fails. Dr. Smith agrees with this."
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id int, text string")
    s = df.select("id", claims.sentences(df["text"]).alias("s")).filter("id = 1").first().s
    assert s == ["We find that A is consistent with B at 3σ level.", "See Fig. Two for details.", "The model, however, fails.", "Dr. Smith agrees with this."]
    out = claims.extract_claims(df).collect()
    assert len(out) == 1 and out[0].confidence == "high" and out[0].polarity_hint == "positive" and not out[0].human_approved
    both = spark.createDataFrame([("It contradicts X but supports Y",)], "t string")
    r = both.select(claims.polarity(both["t"]).alias("p"), claims.polarity_markers(both["t"]).alias("m")).first()
    assert (r.p, r.m) == ("negative", ["contradicts", "supports"])
    long = spark.createDataFrame([("a" * 250 + " confirms bcd.",)], "t string")
    assert len(long.select(claims.sro(long["t"]).alias("s")).first().s.subject) == 200
    papers = spark.createDataFrame([(1, {"Results": t})], "id int, sections map<string,string>")
    assert claims.extract_from_sections(papers).first().source_section == "Results"


def test_layout(spark):
    text = "Preamble text that is certainly longer than fifty characters in all.\n1. Introduction\nSome words.\nMETHODS\nMore words where\n\n2. Introduction\nAgain."
    assert [n for n, _ in layout.sections_of(text)] == ["preamble", "Introduction", "METHODS", "Introduction (2)"]
    assert layout.sections_of("just words") == [("full_text", "just words")] and layout.sections_of(None) == []
    assert [f[1] for f in layout.formula_flags("a\nb\nc ≈ d\nx is\n")] == ["ghost"]
    pages = spark.createDataFrame([("d", i, f"Journal of Things\nbody {i}\nHi") for i in range(4)], "doc string, page int, text string")
    assert [(r.line, r.n_pages) for r in layout.running_heads(pages, "doc", "page").collect()] == [("Journal of Things", 4)]
    assert "Journal" not in layout.full_text(pages, "doc", "page").first().text
    para = spark.createDataFrame([("First sentence that is quite long here.\nSecond one begins and is long too\nwrapped.\n\nshort",)], "t string")
    assert para.select(layout.paragraphs(para["t"]).alias("p")).first().p == ["First sentence that is quite long here.", "Second one begins and is long too wrapped.\nshort"]


def test_patterns(spark):
    rows = [("g", i, float(i)) for i in range(5)] + [("h", 1, 2.0), ("h", 2, 2.0), ("h", 3, 2.01), (None, 1, 1.0)]
    t = {r.group: r for r in patterns.group_trends(spark.createDataFrame(rows, "g string, x int, y double"), "g", "x", "y").collect()}
    assert t["g"].trend == "increases steadily" and t["h"].trend == "remains roughly constant" and len(t) == 2
    v = spark.createDataFrame([("a", 1.0)] * 9 + [("a", 100.0)] + [("b", 1.0), ("b", 50.0)], "g string, v double")
    assert [r.actual for r in patterns.anomalies(v, "g", "v").collect()] == [100.0]
    el = spark.createDataFrame([("H", 1, 1, 1, "diatomic nonmetal"), ("Li", 3, 1, 2, "alkali metal"), ("Be", 4, 2, 2, "alkaline earth metal"), ("Na", 11, 1, 3, "alkali metal")], "id string, number int, `group` int, period int, category string")
    assert {(r.source_id, r.target_id, r.link_type) for r in patterns.element_links(el).collect()} == {("H", "Li", "analogous_to"), ("Li", "Na", "analogous_to"), ("Be", "Li", "correlates_with")}
    wide = patterns.eav_wide(spark.createDataFrame([("a", "m", "1.5"), ("a", "k", "x"), ("b", "k", "3")], "entry_id string, property_name string, property_value string"), ("m",), ("k",))
    assert {(r.entry_id, r.m, r.k) for r in wide.collect()} == {("a", 1.5, None), ("b", None, 3)}


def test_blocks_of_vectors(spark, monkeypatch):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(60, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>")
    whole = sorted(map(tuple, vectors.similar(v, v, 0.3, 4, other=True).collect()))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1000)
    assert [x[:2] for x in sorted(map(tuple, vectors.similar(v, v, 0.3, 4, other=True).collect()))] == [x[:2] for x in whole]
    assert vectors.similar(v.limit(0), v, 0.3).count() == 0 and vectors.similar(v, v.limit(0), 0.3).count() == 0


def test_tiers(spark):
    df = spark.createDataFrame([(0.95,), (0.86,), (0.83,), (0.76,), (0.1,)], "s double")
    got = df.select(vectors.score_to_tier(df["s"]), vectors.channel_tier(df["s"]), charts.edge_width(df["s"]), vectors.propose_link(df["s"])["link_type"]).collect()
    assert [tuple(r) for r in got] == [("1", "tier-1", 3, "analogous to"), ("1.5", "tier-1", 2, "analogous to"), ("2", "tier-1.5", 2, "couples to"), ("2", "tier-1.5", 1, "couples to"), ("2", "tier-2", 1, "related")]
