"""Named queries over the driver's tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators import bridges as br
from cohera.operators import charts, claims, components, coverage, fim, gaps, graph, layout, patterns, report, snapshots
from cohera.operators import vectors as vec
from cohera.plans import tables
from cohera.plans.tables import ENTRIES_SQL, LINKS_SQL, PROPERTIES_SQL, TRADE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) if name is None else F.round(c, 6).alias(name)


def _trade(spark, d):
    nodes = tables.trade_nodes(spark, d)
    from cohera.plans.shared import cut

    return nodes, cut(graph.build_graph(nodes, tables.trade_links(spark, d)))


# ---- graph -------------------------------------------------------------------------------------------------------

ADJ_SQL = "adj AS (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"
#: All shortest paths by relaxation of at most 12 hops: pairs keep their least distance at every hop.
DIST_SQL = f"""{TRADE_SQL}, {ADJ_SQL},
walk AS (
  SELECT id AS src, id AS dst, 0.0::DOUBLE AS d, 0 AS h FROM nodes
  UNION ALL SELECT src, dst, min(d) AS d, h FROM (SELECT w.src, adj.dst, w.d + adj.weight AS d, w.h + 1 AS h FROM walk w JOIN adj ON w.dst = adj.src WHERE w.h < 12) GROUP BY src, dst, h),
dist AS (SELECT src, dst, min(d) AS d FROM walk GROUP BY src, dst)"""
P_SQL = "p AS (SELECT src, dst, exp(-d) / sum(exp(-d)) OVER (PARTITION BY src) AS p FROM dist)"
SCORE_SQL = """able AS (SELECT src FROM adj GROUP BY src HAVING count(*) >= 2),
s AS (
  SELECT a.src AS center, a.dst AS nb, v.id AS u, coalesce(c.p, 0) AS p,
         CASE WHEN coalesce(c.p, 0) < 1e-10 AND coalesce(n.p, 0) < 1e-10 THEN 0.0 WHEN coalesce(c.p, 0) < 1e-10 THEN 20.0
              WHEN coalesce(n.p, 0) < 1e-10 THEN -20.0 ELSE ln(n.p) - ln(c.p) END AS s
  FROM adj a JOIN able ON a.src = able.src CROSS JOIN nodes v LEFT JOIN p c ON c.src = a.src AND c.dst = v.id LEFT JOIN p n ON n.src = a.dst AND n.dst = v.id
  WHERE c.p IS NOT NULL OR n.p IS NOT NULL)"""
FIM_SQL = "f AS (SELECT x.center, x.nb AS i, y.nb AS j, sum(x.s * y.s * x.p) AS f FROM s x JOIN s y ON x.center = y.center AND x.u = y.u AND x.nb <= y.nb GROUP BY 1, 2, 3)"


@query(f"WITH {TRADE_SQL} SELECT a, b, weight FROM edges")
def g01_build_graph(spark, d):
    return _trade(spark, d)[1]


@query(f"""WITH {ENTRIES_SQL}, {LINKS_SQL},
e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM links WHERE source_id IN (SELECT id FROM entries) AND target_id IN (SELECT id FROM entries)),
n AS (SELECT id, count(*) AS c FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id)
SELECT id, coalesce(c, 0) AS degree, c IS NULL AS isolated FROM entries LEFT JOIN n USING (id)""")
def g02_degree_isolated(spark, d):
    e = tables.entries(spark, d)
    return graph.degrees(e, graph.build_graph(e, tables.links(spark, d)))


@query(f"""WITH RECURSIVE {ENTRIES_SQL}, {LINKS_SQL},
e AS (SELECT source_id AS s, target_id AS t FROM links UNION SELECT target_id, source_id FROM links),
w AS (SELECT id AS src, id AS dst, 0 AS h FROM entries WHERE entry_type = 'region' UNION SELECT w.src, e.t, w.h + 1 FROM w JOIN e ON w.dst = e.s WHERE w.h < 3)
SELECT src, dst, CAST(min(h) AS BIGINT) AS d FROM w GROUP BY src, dst""")
def g03_hop_distance(spark, d):
    e = tables.entries(spark, d)
    edges = graph.build_graph(e, tables.links(spark, d))
    return graph.hop_distances(edges, e.filter("entry_type = 'region'").select("id"), 3)


@query(f"WITH RECURSIVE {DIST_SQL} SELECT src, dst, round(d, 6) AS d FROM dist")
def g04_weighted_distance(spark, d):
    nodes, edges = _trade(spark, d)
    return graph.relax_distances(edges, nodes).select("src", "dst", r6("d", "d"))


def _distribution(spark, d):
    nodes, edges = _trade(spark, d)
    k = graph.distances(nodes, edges).withColumn("k", graph.exponential_kernel(F.col("d")))
    return nodes, edges, graph.distribution(k, nodes.count())


@query(f"WITH RECURSIVE {DIST_SQL}, {P_SQL} SELECT src, dst, round(p, 6) AS p FROM p")
def g05_kernel_distribution(spark, d):
    return _distribution(spark, d)[2].select("src", "dst", r6("p", "p"))


@query(f"WITH RECURSIVE {DIST_SQL}, {P_SQL}, {SCORE_SQL} SELECT center, nb, u, round(s, 5) + 0.0 AS s FROM s")
def g06_score_vectors(spark, d):
    return graph.score_vectors(*_distribution(spark, d)).select("center", "nb", "u", (F.round("s", 5) + F.lit(0.0)).alias("s"))


@query(f"WITH RECURSIVE {DIST_SQL}, {P_SQL}, {SCORE_SQL}, {FIM_SQL} SELECT center, i, j, round(f, 5) + 0.0 AS f FROM f")
def g07_fim_matrix(spark, d):
    return graph.fim_matrix(graph.score_vectors(*_distribution(spark, d))).select("center", "i", "j", (F.round("f", 5) + F.lit(0.0)).alias("f"))


@query(f"""WITH RECURSIVE {DIST_SQL}, {P_SQL}, {SCORE_SQL}, {FIM_SQL}
SELECT center, round(pow(sum(CASE WHEN i = j THEN f ELSE 0 END), 2) / sum(CASE WHEN i = j THEN f * f ELSE 2 * f * f END), 5) AS pr FROM f GROUP BY center""")
def g08_participation_ratio(spark, d):
    pr = graph.participation_ratio(graph.fim_matrix(graph.score_vectors(*_distribution(spark, d))))
    return pr.select("center", F.round("pr", 5).alias("pr"))


@query()
def g09_fim_sweep(spark, d):
    return fim.sweep(*_trade(spark, d)).drop("sv_profile", "raw_sigmas")


@query()
def g10_sweep_summary(spark, d):
    return report.tier1(fim.sweep(*_trade(spark, d)))


@query(f"""WITH {TRADE_SQL}, br AS (
  SELECT 'nation_' || n_nationkey AS r, 'region_' || n_regionkey AS w, 0.70 + n_nationkey / 100.0 AS sim FROM nation),
x AS (
  SELECT least('rrp::' || source_id, 'rrp::' || target_id) AS a, greatest('rrp::' || source_id, 'rrp::' || target_id) AS b, CASE confidence_tier WHEN '1' THEN 1.0 WHEN '1.5' THEN 1.5 WHEN '2' THEN 2.0 ELSE 3.0 END::DOUBLE AS w, 'rrp' AS t FROM trade
  UNION ALL SELECT 'rrp::' || r, 'wiki::' || w, (1 - sim)::DOUBLE, 'bridge' FROM br WHERE sim >= 0.75)
SELECT a, b, round(min(w), 6) AS weight, arg_min(t, w) AS type FROM x GROUP BY a, b""")
def g11_bridge_graph_edges(spark, d):
    nation = tables.read(spark, d, "nation")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    b = nation.select(s("nation_", "n_nationkey").alias("rrp_entry_id"), s("region_", "n_regionkey").alias("ds_entry_id"), (F.lit(0.70) + F.col("n_nationkey") / 100.0).alias("similarity"))
    wiki = tables.read(spark, d, "region").select(s("region_", "r_regionkey").alias("id"), F.col("r_name").alias("title"))
    none = tables.trade_links(spark, d).limit(0)
    _, edges = graph.bridge_graph(tables.trade_nodes(spark, d), tables.trade_links(spark, d), wiki, none, b)
    return edges.select("a", "b", r6("weight", "weight"), "type")


@query(f"""WITH {LINKS_SQL}, n AS (
  SELECT source_id AS node, 'region_' || n_regionkey AS r FROM links JOIN nation ON target_id = 'nation_' || n_nationkey
  UNION SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation UNION SELECT 'region_' || n_regionkey, 'region_' || n_regionkey FROM nation)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM n""")
def g12_components(spark, d):
    return components.connected_components(tables.links(spark, d).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")))


@query()
def g13_directed_sweep(spark, d):
    nodes = tables.trade_nodes(spark, d)
    links = tables.trade_links(spark, d).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("weight")).distinct()
    return fim.sweep(nodes, links, directed=True, weighted=False).drop("sv_profile", "raw_sigmas")


@query()
def g14_ordered_nodes(spark, d):
    return fim.ordered_nodes(fim.sweep(*_trade(spark, d))).select("entry_id", "d_eff", r6("disorder_index", "eta"), "regime")


@query()
def g15_top_hubs(spark, d):
    return fim.top_hubs(fim.sweep(*_trade(spark, d)), 10).select("entry_id", "d_eff", r6("participation_ratio", "pr"))


# ---- coverage ----------------------------------------------------------------------------------------------------


def _bundle(spark, d):
    return tables.entries(spark, d), tables.links(spark, d), tables.properties(spark, d)


def _sections(spark, d):
    part = tables.read(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entry_id"), F.col("p_type").alias("content"))
    nation = tables.read(spark, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("entry_id"), F.col("n_name").alias("content"))
    return part.unionByName(nation)


SECTIONS_SQL = "sections AS (SELECT 'part_' || p_partkey AS entry_id, p_type AS content FROM part WHERE p_size < 25 UNION ALL SELECT 'nation_' || n_nationkey, n_name FROM nation)"
ISO_SQL = "iso AS (SELECT id FROM entries WHERE id NOT IN (SELECT source_id FROM links) AND id NOT IN (SELECT target_id FROM links))"


@query(f"""WITH {ENTRIES_SQL}, {LINKS_SQL}, {PROPERTIES_SQL}, {SECTIONS_SQL}, {ISO_SQL}
SELECT (SELECT count(*) FROM entries) AS entries, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM sections) AS sections,
       (SELECT count(*) FROM props) AS properties, CAST(0 AS BIGINT) AS bridges, CAST(0 AS BIGINT) AS math_interpretations, (SELECT count(*) FROM iso) AS isolated""")
def c01_bundle_stats(spark, d):
    e, k, p = _bundle(spark, d)
    none = spark.range(0)
    return coverage.bundle_stats(e, k, _sections(spark, d), p, none, none)


@query(f"""WITH {ENTRIES_SQL}, {LINKS_SQL}
SELECT 'entry_type' AS what, entry_type AS value, count(*) AS n FROM entries GROUP BY entry_type
UNION ALL SELECT 'domain', coalesce(domain, 'unknown'), count(*) FROM entries GROUP BY 2
UNION ALL SELECT 'link_type', link_type, count(*) FROM links GROUP BY link_type
UNION ALL SELECT 'tier', coalesce(confidence_tier, 'original'), count(*) FROM links GROUP BY 2""")
def c02_distributions(spark, d):
    e, k, _ = _bundle(spark, d)
    out = None
    for what, df, col, none in (("entry_type", e, "entry_type", "unknown"), ("domain", e, "domain", "unknown"), ("link_type", k, "link_type", "unknown"), ("tier", k, "confidence_tier", "original")):
        one = coverage.distribution(df, col, none).select(F.lit(what).alias("what"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {ENTRIES_SQL}, {SECTIONS_SQL}
SELECT entry_type, count(DISTINCT id) AS n_entries, count(entry_id) AS n_sections, round(count(entry_id) / count(DISTINCT id), 1) AS avg_sections FROM entries LEFT JOIN sections ON id = entry_id GROUP BY entry_type""")
def c03_section_stats(spark, d):
    return coverage.section_stats(tables.entries(spark, d), _sections(spark, d))


@query(f"""WITH {ENTRIES_SQL}, {PROPERTIES_SQL}
SELECT property_name, count(DISTINCT CASE WHEN property_value IS NOT NULL AND property_value <> '' THEN entry_id END) AS filled, (SELECT count(*) FROM entries) AS total_entities,
       round(count(DISTINCT CASE WHEN property_value IS NOT NULL AND property_value <> '' THEN entry_id END) / (SELECT count(*) FROM entries) * 100, 1) AS coverage_pct FROM props GROUP BY property_name""")
def c04_property_coverage(spark, d):
    e, _, p = _bundle(spark, d)
    return coverage.property_coverage(e, p)


@query(f"""WITH {ENTRIES_SQL}, {PROPERTIES_SQL}
SELECT lower(property_value) AS value, count(*) AS n FROM props WHERE property_name = 'dimensional_sensitivity' GROUP BY 1
UNION ALL SELECT 'missing', (SELECT count(*) FROM entries) - (SELECT count(*) FROM props WHERE property_name = 'dimensional_sensitivity')""")
def c05_sensitivity(spark, d):
    e, _, p = _bundle(spark, d)
    return coverage.sensitivity(e, p)


@query(f"""WITH {ENTRIES_SQL}, {LINKS_SQL}, {ISO_SQL}, c AS (SELECT (SELECT count(*) FROM entries) AS n, (SELECT count(*) FROM links) AS m)
SELECT n AS n_entries, m AS n_links, n * (n - 1) // 2 AS possible_pairs, round(m / (n * (n - 1) // 2), 6) AS link_density, round(m / n, 2) AS avg_links, (SELECT count(*) FROM iso) AS isolated_count FROM c""")
def c06_network_metrics(spark, d):
    e, k, _ = _bundle(spark, d)
    return coverage.network_metrics(e, k)


GAPS_SQL = f"""{ENTRIES_SQL}, {LINKS_SQL}, {PROPERTIES_SQL},
tot AS (SELECT entry_type, count(*) AS t FROM entries GROUP BY 1), have AS (SELECT DISTINCT entry_id, property_name FROM props WHERE property_value <> ''),
cov AS (SELECT entry_type, property_name, count(*) AS filled FROM have JOIN entries ON id = entry_id GROUP BY 1, 2),
pg AS (SELECT entry_type, property_name, t AS total_of_type, filled, t - filled AS missing_count, round(filled / t * 100, 1) AS coverage_pct,
         CASE WHEN (t - filled) / t > 0.5 THEN 1 WHEN (t - filled) / t > 0.2 THEN 2 ELSE 3 END AS priority FROM cov JOIN tot USING (entry_type) WHERE filled / t < 0.8),
n AS (SELECT count(*) AS n FROM entries),
tx AS (SELECT property_name AS taxonomy_name, property_value AS value, count(*) AS count FROM props WHERE property_value <> '' AND property_name IN ('mathematical_archetype', 'dimensional_sensitivity', 'concept_tags') GROUP BY 1, 2),
tg AS (SELECT *, CASE WHEN count <= 1 THEN 'singleton' ELSE 'sparse' END AS gap_type FROM (SELECT taxonomy_name, value, count, round(count / sum(count) OVER (PARTITION BY taxonomy_name) * 100, 1) AS pct_of_filled FROM tx), n WHERE count <= 2 OR count / n < 0.03),
tb AS (SELECT entry_type AS entity_type, t AS observed, CAST(greatest(3, floor(0.02 * n)) AS BIGINT) AS expected_min, CAST(greatest(3, floor(0.02 * n)) AS BIGINT) - t AS deficit FROM tot, n WHERE t < greatest(3, floor(0.02 * n))),
ends AS (SELECT source_id AS id, target_id AS other, confidence_tier AS tier FROM links UNION ALL SELECT target_id, source_id, confidence_tier FROM links),
la AS (SELECT ends.id, count(*) AS total_links, bool_or(coalesce(tier, 'original') = '1') AS tier1, count(o.entry_type) AS known, sum(CAST(o.entry_type = e.entry_type AS INT)) AS same
       FROM ends JOIN entries e ON e.id = ends.id LEFT JOIN entries o ON o.id = ends.other GROUP BY ends.id),
lg AS (SELECT * FROM (SELECT entries.id AS entry_id, entry_type AS entity_type, coalesce(total_links, 0) AS total_links,
        CASE WHEN total_links IS NULL THEN 'isolated' WHEN NOT tier1 THEN 'no_tier1' WHEN total_links >= 3 AND known > 0 AND known = same THEN 'same_type_only' END AS gap_type FROM entries LEFT JOIN la USING (id)) WHERE gap_type IS NOT NULL)"""


@query(f"""WITH {GAPS_SQL}, lost AS (SELECT pg.entry_type, pg.property_name, id, row_number() OVER (PARTITION BY pg.entry_type, pg.property_name ORDER BY id) AS r
  FROM pg JOIN entries USING (entry_type) LEFT JOIN have ON have.entry_id = id AND have.property_name = pg.property_name WHERE have.entry_id IS NULL)
SELECT pg.*, m.missing_ids FROM pg JOIN (SELECT entry_type, property_name, string_agg(id, ',' ORDER BY id) AS missing_ids FROM lost WHERE r <= 10 GROUP BY 1, 2) m USING (entry_type, property_name)""")
def c07_property_gaps(spark, d):
    e, _, p = _bundle(spark, d)
    return gaps.property_gaps(e, p).withColumn("missing_ids", F.array_join("missing_ids", ","))


@query(f"WITH {GAPS_SQL} SELECT taxonomy_name, value, count, pct_of_filled, gap_type FROM tg")
def c08_taxonomy_gaps(spark, d):
    e, _, p = _bundle(spark, d)
    return gaps.taxonomy_gaps(e, p)


@query(f"WITH {GAPS_SQL} SELECT * FROM tb")
def c09_type_balance(spark, d):
    return gaps.type_balance_gaps(tables.entries(spark, d))


@query(f"WITH {GAPS_SQL} SELECT * FROM lg")
def c10_link_gaps(spark, d):
    e, k, _ = _bundle(spark, d)
    return gaps.link_gaps(e, k)


@query(f"""WITH {GAPS_SQL}, x AS (
  SELECT 'add_property' AS action, entry_type || '.' || property_name AS target, round(least(1.0, missing_count / n), 3) AS impact_score FROM pg, n
  UNION ALL SELECT 'add_entry', entity_type, round(least(1.0, deficit / greatest(1, expected_min)), 3) FROM tb
  UNION ALL SELECT 'add_link', CASE gap_type WHEN 'isolated' THEN 'isolated_entries' ELSE 'no_tier1_entries' END, round(CASE gap_type WHEN 'isolated' THEN least(1.0, count(*) / max(n)) ELSE least(0.6, count(*) / max(n) * 2) END, 3) FROM lg, n WHERE gap_type <> 'same_type_only' GROUP BY gap_type
  UNION ALL SELECT 'add_taxonomy', taxonomy_name || ':' || value, CASE WHEN count <= 1 THEN 0.4 ELSE 0.2 END FROM tg)
SELECT row_number() OVER (ORDER BY impact_score DESC, action, target) AS rank, action, target, CAST(impact_score AS DOUBLE) AS impact_score FROM x""")
def c11_enrichment_priorities(spark, d):
    return gaps.enrichment_priorities(*_bundle(spark, d))


@query(f"""WITH {ENTRIES_SQL}, {{b}}, s AS (SELECT count(*) AS n, sum(CAST(confidence_tier = '1.5' AS INT)) AS k, avg(similarity) AS m FROM b), h AS (SELECT max(c) AS hub FROM (SELECT count(*) AS c FROM b GROUP BY ds_entry_id)), t AS (SELECT count(DISTINCT source_type) AS src FROM entries)
SELECT CASE WHEN n = 0 THEN 'unknown' WHEN k / n < 0.01 AND m < 0.808 AND src <= 2 THEN 'entity_catalog' WHEN k / n > 0.02 AND src >= 3 THEN 'law_catalog' WHEN hub / n > 0.5 AND src <= 2 THEN 'entity_catalog' ELSE 'unknown' END AS dataset_type,
       CAST(CASE WHEN n = 0 THEN 0.0 WHEN k / n < 0.01 AND m < 0.808 AND src <= 2 THEN 0.85 WHEN k / n > 0.02 AND src >= 3 THEN 0.85 WHEN hub / n > 0.5 AND src <= 2 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
       round(k / n, 4) AS tier_1_5_ratio, round(m, 4) AS mean_sim, src AS source_type_count, round(hub / n, 4) AS max_hub_frac, n AS total_bridges FROM s, h, t""".replace("{b}", "{BRIDGES}"))
def c12_dataset_fingerprint(spark, d):
    return coverage.dataset_fingerprint(tables.entries(spark, d), _bridges(spark, d))


@query()
def c13_gap_texts(spark, d):
    return coverage.gap_texts(*_bundle(spark, d))


@query(f"""WITH {ENTRIES_SQL}, {PROPERTIES_SQL}
SELECT property_name, property_value, count(*) AS n, count(*) < 0.03 * (SELECT count(*) FROM entries) AS sparse FROM props WHERE property_value <> '' GROUP BY 1, 2""")
def c14_vocabulary(spark, d):
    e, _, p = _bundle(spark, d)
    return coverage.vocabulary(e, p)


@query(f"""WITH {ENTRIES_SQL}, {LINKS_SQL}, {ISO_SQL}, c AS (SELECT (SELECT count(*) FROM entries) AS n, (SELECT count(*) FROM links) AS m)
SELECT (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM iso ORDER BY id LIMIT 10)) AS first_isolated,
       (SELECT string_agg(domain, ',' ORDER BY k DESC, domain) FROM (SELECT domain, count(*) AS k FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_domains, n AS n_entries, round(m / n, 2) AS avg_links FROM c""")
def c15_compact_stats(spark, d):
    e, k, _ = _bundle(spark, d)
    return coverage.compact_stats(e, k).select(F.array_join("first_isolated", ",").alias("first_isolated"), F.array_join("top_domains", ",").alias("top_domains"), "n_entries", "avg_links")


@query(f"""WITH {LINKS_SQL}, {ENTRIES_SQL} SELECT link_type, s.entry_type AS source_type, t.entry_type AS target_type, coalesce(confidence_tier, 'original') AS tier, count(*) AS n
FROM links LEFT JOIN entries s ON s.id = source_id LEFT JOIN entries t ON t.id = target_id GROUP BY 1, 2, 3, 4""")
def c16_typed_links(spark, d):
    e, k, _ = _bundle(spark, d)
    side = lambda c: e.select(F.col("id").alias(f"{c}_id"), F.col("entry_type").alias(f"{c}_type"))
    j = k.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return j.groupBy("link_type", "source_type", "target_type", F.coalesce("confidence_tier", F.lit("original")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# ---- vectors -----------------------------------------------------------------------------------------------------

V_SQL = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
LEAST = 0.70


def _sides(spark, d):
    v = tables.vectors(spark, d)
    return v.filter("id % 2 = 0"), v.filter("id % 2 = 1")


def _bridges(spark, d):
    """Bridges of even to odd vectors by the shifted similarity, under which 0.70 is a cosine of 0.40."""
    return vec.topk_bridges(*_sides(spark, d), threshold=0.65, kind="half_shift")


BRIDGES_SQL = f"""{V_SQL}, sim AS (SELECT a.id AS rrp_entry_id, b.id AS ds_entry_id, (1 + list_cosine_similarity(a.e, b.e)) / 2 AS similarity FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1),
b AS (SELECT rrp_entry_id, ds_entry_id, similarity, CASE WHEN similarity >= 0.85 THEN 'analogous to' WHEN similarity >= 0.75 THEN 'couples to' ELSE 'related' END AS proposed_link_type,
        CASE WHEN similarity >= 0.85 THEN '1.5' ELSE '2' END AS confidence_tier
      FROM (SELECT *, row_number() OVER (PARTITION BY rrp_entry_id ORDER BY similarity DESC, ds_entry_id) AS r FROM sim WHERE similarity >= 0.65) WHERE r <= 3)"""
SQL["c12_dataset_fingerprint"] = SQL["c12_dataset_fingerprint"].replace("{BRIDGES}", BRIDGES_SQL)


@query(f"WITH {BRIDGES_SQL} SELECT rrp_entry_id, ds_entry_id, round(similarity, 6) AS similarity, proposed_link_type, confidence_tier FROM b")
def v01_topk_bridges(spark, d):
    return _bridges(spark, d).select("rrp_entry_id", "ds_entry_id", r6("similarity", "similarity"), "proposed_link_type", "confidence_tier")


@query(f"""WITH {V_SQL}, m AS (SELECT label, pos, avg(e[pos]) AS x FROM v, unnest(range(1, 65)) AS t(pos) GROUP BY 1, 2)
SELECT label, CAST(pos - 1 AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0.0 AS x FROM m""")
def v02_entry_centroids(spark, d):
    c = vec.centroids(tables.vectors(spark, d), "label")
    return c.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(f"""WITH {V_SQL} SELECT id, other, rank, round(c, 4) AS score FROM (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= 5""")
def v03_top5_neighbours(spark, d):
    v = tables.vectors(spark, d)
    near = vec.similar(v, v, None, 5, other=True)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")).cast("long")
    return near.select("id", "other", rank.alias("rank"), F.round("cosine", 4).alias("score"))


def _typed(spark, d):
    v = tables.vectors(spark, d)
    return v.select("id", F.concat(F.lit("t"), F.col("label").cast("string")).alias("entry_type")), v, v.filter("id % 7 = 0").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("derives from").alias("link_type"))


PAIRS_SQL = f"""{V_SQL}, pr AS (SELECT a.id, b.id AS other, least('t' || a.label, 't' || b.label) AS t1, greatest('t' || a.label, 't' || b.label) AS t2, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id < b.id),
base AS (SELECT t1, t2, CASE WHEN count(*) >= 5 THEN avg(c) ELSE (SELECT avg(c) FROM pr) END AS baseline, count(*) AS n_pairs FROM pr GROUP BY 1, 2),
lk AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 7 = 0)"""


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT id, other, t1, t2, c, baseline, CASE WHEN baseline <= 0 THEN 0 ELSE c / baseline END AS surprise FROM pr JOIN base USING (t1, t2) LEFT JOIN lk ON lk.a = id AND lk.b = other WHERE c >= 0.30 AND lk.a IS NULL)
SELECT id, other, t1, t2, round(c, 4) AS similarity FROM s WHERE surprise >= 1.15 ORDER BY surprise DESC, c DESC, id, other LIMIT 200""")
def v04_surprising_pairs(spark, d):
    return vec.surprising_pairs(*_typed(spark, d), least_sim=0.30).select("id", "other", "t1", "t2", "similarity")


@query(f"WITH {PAIRS_SQL} SELECT id, other, round(c, 4) AS similarity FROM pr LEFT JOIN lk ON lk.a = id AND lk.b = other WHERE c >= 0.30 AND lk.a IS NULL ORDER BY c DESC, id, other LIMIT 100")
def v05_link_candidates(spark, d):
    _, v, k = _typed(spark, d)
    return vec.link_candidates(v, k, least=0.30)


CENTRE_SQL = f"""{V_SQL}, m AS (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(e[pos] / sqrt(list_dot_product(e, e))) AS x FROM (SELECT e, unnest(range(1, 65)) AS pos FROM v) GROUP BY pos)),
dd AS (SELECT id AS chunk_id, round(1 - list_cosine_similarity(e, m), 4) AS centroid_distance FROM v, m)"""


@query(f"""WITH {CENTRE_SQL} SELECT chunk_id, centroid_distance, round((centroid_distance - (SELECT avg(centroid_distance) FROM dd)) / (SELECT stddev_pop(centroid_distance) FROM dd), 4) AS z
FROM dd WHERE centroid_distance > (SELECT avg(centroid_distance) + 2 * stddev_pop(centroid_distance) FROM dd)""")
def v06_centroid_outliers(spark, d):
    chunks = tables.vectors(spark, d).select(F.col("id").alias("chunk_id"), F.col("vec").alias("embedding"))
    return snapshots.isolated_chunks(snapshots.centroid_distances(chunks)).select("chunk_id", "centroid_distance", F.round("z", 4).alias("z"))


@query(f"""WITH {V_SQL}, near AS (SELECT * FROM (SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1 AND list_cosine_similarity(a.e, b.e) >= 0.15) WHERE r <= 15),
st AS (SELECT * FROM near WHERE c >= 0.25), tn AS (SELECT vec_id AS a, vec_id + 2 AS b FROM embeddings WHERE vec_id % 3 = 1),
bad AS (SELECT DISTINCT id, unnest([x.other, y.other]) AS other FROM st x JOIN tn ON tn.a = x.other JOIN st y USING (id) WHERE y.other = tn.b),
g AS (SELECT near.id, count(*) FILTER (WHERE c >= 0.25 AND bad.id IS NULL) AS n_support, count(bad.id) AS n_contradict, count(*) FILTER (WHERE c < 0.25) AS n_related, max(c) AS best FROM near LEFT JOIN bad USING (id, other) GROUP BY near.id)
SELECT v.id, coalesce(n_support, 0) AS n_support, coalesce(n_contradict, 0) AS n_contradict, coalesce(n_related, 0) AS n_related, round(best, 6) AS best,
       round(coalesce(least(1.0, greatest(0.0, (n_support - 0.5 * n_contradict) / greatest(1, n_support + n_contradict + n_related))), 0), 6) AS score FROM v LEFT JOIN g USING (id) WHERE v.id % 2 = 0""")
def v07_claim_validation(spark, d):
    v = tables.vectors(spark, d)
    tense = v.filter("id % 3 = 1").select(F.col("id").alias("source_id"), (F.col("id") + 2).alias("target_id"), F.lit("tensions with").alias("link_type"))
    out = vec.validate_claim(*_sides(spark, d), tense, 15, 0.25, 0.15)
    return out.select("id", "n_support", "n_contradict", "n_related", r6("best", "best"), r6("score", "score"))


@query(f"WITH {PAIRS_SQL} SELECT t1, t2, n_pairs, round(baseline, 6) + 0.0 AS baseline FROM base")
def v08_type_pair_baselines(spark, d):
    typed, v, _ = _typed(spark, d)
    return vec.type_pair_baselines(typed, v).select("t1", "t2", "n_pairs", (F.round("baseline", 6) + F.lit(0.0)).alias("baseline"))


@query(f"""WITH {V_SQL}, near AS (SELECT * FROM (SELECT a.id, b.id AS chunk, b.label, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1) WHERE r <= 20)
SELECT id, label AS entry_id, round(max((1 + c) / 2), 6) AS similarity FROM near GROUP BY 1, 2""")
def v09_best_chunks(spark, d):
    own, kb = _sides(spark, d)
    chunks = kb.select(F.col("id").alias("chunk_id"), F.col("label").alias("entry_id"), "vec")
    return vec.best_chunks(chunks, own, 20).select("id", "entry_id", r6("similarity", "similarity"))


@query(f"""WITH {V_SQL}, near AS (SELECT * FROM (SELECT a.id, b.label, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1) WHERE r <= 30),
g AS (SELECT id, label AS entry_id, max(c) AS s FROM near GROUP BY 1, 2)
SELECT id, entry_id, round(s, 6) AS similarity, CASE WHEN s >= 0.85 THEN 'tier-1' WHEN s >= 0.75 THEN 'tier-1.5' ELSE 'tier-2' END AS channel
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, entry_id) AS k FROM g WHERE s >= 0.2) WHERE k <= 10""")
def v10_resolve_claims(spark, d):
    v = tables.vectors(spark, d)
    chunks = v.filter("id % 2 = 1").select(F.col("id").alias("chunk_id"), F.col("label").alias("entry_id"), "vec")
    return vec.resolve_claims(v.filter("id % 2 = 0").select("id", "vec"), chunks, 10, 0.2).select("id", "entry_id", r6("similarity", "similarity"), "channel")


# ---- bridges -----------------------------------------------------------------------------------------------------


def _kb_sweep(spark, d):
    """A made-up sweep of the odd vectors: disorder by id."""
    kb = _sides(spark, d)[1]
    eta = (F.col("id") % 100) / 100.0
    return kb.select(F.col("id").alias("entry_id"), eta.alias("disorder_index"), fim.regime(eta).alias("regime"), (F.col("id") % 11 == 0).alias("skipped"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3 + 1).cast("int")).alias("formality_tier"))


KB_SQL = """kb AS (SELECT vec_id AS id, (vec_id % 100) / 100.0 AS eta, vec_id % 11 = 0 AS skipped, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 3 + 1 END AS tier FROM embeddings WHERE vec_id % 2 = 1)"""
TRUST_SQL = f"""{BRIDGES_SQL}, {KB_SQL}, j AS (SELECT b.*, CASE WHEN skipped THEN 1.0 ELSE eta END::DOUBLE AS eta2, CAST(coalesce(tier, 2) AS INT) AS t, skipped FROM b JOIN kb ON kb.id = ds_entry_id),
tr AS (SELECT rrp_entry_id, ds_entry_id, t AS formality_tier, eta2 < CASE t WHEN 1 THEN 0.6 WHEN 2 THEN 0.65 ELSE 0.75 END AS structured, (1 - eta2) * similarity * CASE t WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.7 END AS trust,
   CASE WHEN skipped THEN 'degenerate' WHEN eta2 < 0.35 THEN 'radial_dominated' WHEN eta2 < 0.65 THEN 'isotropic' ELSE 'noise_dominated' END AS regime FROM j)"""


def _trust(spark, d):
    kb = _kb_sweep(spark, d)
    return br.score_bridges(_bridges(spark, d), kb, br.formality(kb.withColumnRenamed("entry_id", "id")))


@query(f"WITH {TRUST_SQL} SELECT rrp_entry_id, ds_entry_id, formality_tier, structured, round(trust, 6) AS trust, regime FROM tr")
def b01_trust_scores(spark, d):
    return _trust(spark, d).select("rrp_entry_id", "ds_entry_id", "formality_tier", "structured", r6("trust", "trust"), "regime")


def _domained(spark, d):
    b = _bridges(spark, d)
    names = F.array(*[F.lit(x) for x in ("physics", "chemistry · biology", "mathematics", "formal logic", "earth sciences, networks", "")])
    kinds = F.array(*[F.lit(x) for x in ("derives from", "couples to", "tensions with", "generalizes", "odd type")])
    at = lambda a, c, n: F.element_at(a, (F.col(c) % n + 1).cast("int"))
    return b.select("rrp_entry_id", "ds_entry_id", at(names, "rrp_entry_id", 6).alias("source_domain"), at(names, "ds_entry_id", 5).alias("target_domain"), F.when(F.col("ds_entry_id") % 7 != 0, at(kinds, "ds_entry_id", 5)).alias("proposed_link_type"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in br.ADJACENT)
DOMAIN_SQL = f"""{BRIDGES_SQL}, n AS (SELECT ['physics', 'chemistry · biology', 'mathematics', 'formal logic', 'earth sciences, networks', ''] AS n, ['derives from', 'couples to', 'tensions with', 'generalizes', 'odd type'] AS k),
dm AS (SELECT rrp_entry_id, ds_entry_id, n[rrp_entry_id % 6 + 1] AS sd, n[ds_entry_id % 5 + 1] AS td, coalesce(CASE WHEN ds_entry_id % 7 <> 0 THEN k[ds_entry_id % 5 + 1] END, 'couples to') AS t FROM b, n),
parts AS (SELECT *, CASE WHEN sd = '' THEN ['unknown'] ELSE string_split_regex(lower(sd), ' · |, ') END AS sl, CASE WHEN td = '' THEN ['unknown'] ELSE string_split_regex(lower(td), ' · |, ') END AS tl FROM dm),
adj(a, b) AS (SELECT * FROM (VALUES {_PAIRS})), adj2 AS (SELECT a, b FROM adj UNION SELECT b, a FROM adj),
near AS (SELECT DISTINCT rrp_entry_id, ds_entry_id FROM (SELECT rrp_entry_id, ds_entry_id, s, unnest(tl) AS t2 FROM (SELECT *, unnest(sl) AS s FROM parts)) LEFT JOIN adj2 ON adj2.a = s AND adj2.b = t2 WHERE s = t2 OR adj2.a IS NOT NULL),
ck AS (SELECT parts.*, CASE WHEN t IN ('tensions with', 'predicts for', 'analogous to', 'couples to', 'tests') THEN 'valid' WHEN t IN ('derives from', 'generalizes', 'implements', 'constrains') AND near.rrp_entry_id IS NOT NULL THEN 'valid' ELSE 'warning' END AS status
  FROM parts LEFT JOIN near USING (rrp_entry_id, ds_entry_id))"""


@query(f"WITH {DOMAIN_SQL} SELECT rrp_entry_id, ds_entry_id, status FROM ck")
def b02_domain_boundaries(spark, d):
    return br.check_domains(_domained(spark, d)).select("rrp_entry_id", "ds_entry_id", "status")


@query(f"""WITH {DOMAIN_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'warning') AS n_warning, CAST(0 AS BIGINT) AS n_violation,
(SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(tl) AS x FROM parts) WHERE x <> 'unknown') AS domain_coverage FROM ck""")
def b03_domain_summary(spark, d):
    return br.domain_summary(br.check_domains(_domained(spark, d))).withColumn("domain_coverage", F.array_join("domain_coverage", ","))


def _polar_links(spark, d):
    """Links among even vectors, with polarity types by id."""
    kinds = F.array(*[F.lit(x) for x in (*br.POLARITY, "produces")])
    own = _sides(spark, d)[0]
    return own.filter("id % 3 <> 0").select(F.col("id").alias("source_id"), (F.col("id") + 2).alias("target_id"), F.element_at(kinds, (F.col("id") % 10 + 1).cast("int")).alias("link_type"))


_POL = "[" + ", ".join(str(v) for v in [*br.POLARITY.values(), 0.0]) + "]"
ALIGN_SQL = f"""{BRIDGES_SQL}, lp AS (SELECT vec_id AS s, vec_id + 2 AS t, {_POL}[vec_id % 10 + 1]::DOUBLE AS p FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0), l AS (SELECT * FROM lp WHERE p <> 0),
own AS (SELECT s AS id, avg(p) AS own FROM l GROUP BY s), direct AS (SELECT rrp_entry_id AS id, ds_entry_id AS ds, similarity AS sim, coalesce(own, 0) AS own FROM b LEFT JOIN own ON own.id = rrp_entry_id),
hop AS (SELECT s AS id, ds_entry_id AS ds, similarity AS sim, p FROM l JOIN b ON rrp_entry_id = t),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, ds ORDER BY abs(p) DESC, p DESC, sim DESC) AS r FROM hop) WHERE r = 1),
pa AS (SELECT direct.id, direct.ds, direct.sim, CASE WHEN abs(p) > abs(own) THEN p ELSE own END AS pol, CASE WHEN abs(p) > abs(own) THEN 2 ELSE 1 END AS hops FROM direct LEFT JOIN best USING (id, ds)
  UNION ALL SELECT hop.id, hop.ds, hop.sim, p, 2 FROM hop LEFT JOIN direct USING (id, ds) WHERE direct.id IS NULL),
en AS (SELECT id AS entry_id, count(*) AS n_bridges, coalesce(avg(pol) FILTER (WHERE abs(pol) > 0.1), 0) AS net FROM pa GROUP BY id)"""


def _paths(spark, d):
    return br.aligned_bridges(_sides(spark, d)[0], _polar_links(spark, d), _bridges(spark, d))


@query(f"WITH {ALIGN_SQL} SELECT entry_id, n_bridges, round(net, 6) + 0.0 AS net_polarity, CASE WHEN net > 0.3 THEN 'aligned' WHEN net < -0.3 THEN 'contested' ELSE 'neutral' END AS label FROM en")
def b04_structural_alignment(spark, d):
    return br.entry_alignment(_paths(spark, d)).select("entry_id", "n_bridges", (r6("net_polarity") + F.lit(0.0)).alias("net_polarity"), "label")


@query(f"WITH {ALIGN_SQL} SELECT count(*) AS n_entries, round(coalesce(avg(net) FILTER (WHERE abs(net) > 0.1), 0), 6) AS paper_polarity FROM en")
def b05_paper_alignment(spark, d):
    return br.paper_alignment(br.entry_alignment(_paths(spark, d))).select("n_entries", r6("paper_polarity", "paper_polarity"))


@query(f"WITH {ALIGN_SQL} SELECT ds AS ds_entry_id, round(avg(pol * sim), 6) AS mean_score FROM pa WHERE pol <> 0 GROUP BY ds")
def b06_kb_alignment(spark, d):
    return br.kb_alignment(_paths(spark, d)).select("ds_entry_id", r6("mean_score", "mean_score"))


@query(f"WITH {BRIDGES_SQL} SELECT ds_entry_id, count(*) AS n_bridges FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def b07_anchor_load(spark, d):
    return br.anchor_load(_bridges(spark, d))


@query(f"""WITH {BRIDGES_SQL}, {KB_SQL}, a AS (SELECT DISTINCT ds_entry_id FROM b), g AS (SELECT CAST(coalesce(tier, 2) AS INT) AS formality_tier, count(*) AS n_anchors FROM a JOIN kb ON id = ds_entry_id GROUP BY 1)
SELECT formality_tier, n_anchors, round(sum(n_anchors * CASE formality_tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.7 END) OVER () / sum(n_anchors) OVER (), 6) AS mean_weight FROM g""")
def b08_formality(spark, d):
    out = br.formality_breakdown(_bridges(spark, d), br.formality(_kb_sweep(spark, d).withColumnRenamed("entry_id", "id")))
    return out.select("formality_tier", "n_anchors", r6("mean_weight", "mean_weight"))


@query(f"WITH {BRIDGES_SQL} SELECT count(DISTINCT ds_entry_id) AS unique_anchors, count(DISTINCT rrp_entry_id) AS covered, (SELECT count(*) FROM v WHERE id % 2 = 0) AS total, round(count(DISTINCT rrp_entry_id) / (SELECT count(*) FROM v WHERE id % 2 = 0), 6) AS coverage FROM b")
def b09_reach(spark, d):
    return br.reach(_sides(spark, d)[0], _bridges(spark, d)).withColumn("coverage", r6("coverage"))


@query(f"""WITH {BRIDGES_SQL}, {KB_SQL}, t AS (SELECT DISTINCT ds_entry_id, similarity, confidence_tier FROM b)
SELECT CASE WHEN skipped THEN 'skipped' WHEN eta >= 0.65 THEN 'noise' ELSE 'structured' END AS outcome, count(*) AS n FROM t JOIN kb ON id = ds_entry_id GROUP BY 1""")
def b10_bridge_targets(spark, d):
    return report.bridge_targets(_bridges(spark, d), _kb_sweep(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BRIDGES_SQL} SELECT rrp_entry_id, ds_entry_id, round(similarity, 6) AS similarity FROM b ORDER BY b.similarity DESC, rrp_entry_id, ds_entry_id LIMIT 10")
def b11_strongest(spark, d):
    return br.strongest(_bridges(spark, d)).select("rrp_entry_id", "ds_entry_id", r6("similarity", "similarity"))


@query()
def r00_coherence_report(spark, d):
    """The whole report: nations as the bundle, regions as the knowledge base."""
    nation = tables.read(spark, d, "nation")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    b = nation.select(s("nation_", "n_nationkey").alias("rrp_entry_id"), s("region_", "n_regionkey").alias("ds_entry_id"), (F.lit(0.70) + F.col("n_nationkey") / 100.0).alias("similarity"))
    wiki = tables.read(spark, d, "region").select(s("region_", "r_regionkey").alias("id"), F.col("r_name").alias("title"))
    links = tables.trade_links(spark, d)
    return report.generate("trade", tables.trade_nodes(spark, d), links, wiki, links.limit(0), b)


# ---- text --------------------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(string_split(t, chr(1))) AS BIGINT) AS n_raw FROM s""")
def t01_sentence_breaks(spark, d):
    docs = tables.read(spark, d, "documents")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+([A-Z])", "$1\u0001$2")
    return docs.select("doc_id", F.size(F.split(t, "\u0001")).cast("long").alias("n_raw"))


ABBR_SQL = ", ".join(f"'{a}'" for a in claims.ABBREVIATIONS)


@query(rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS c, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(range(2, len(c) + 1), lambda i: lower(string_split_regex(trim(regexp_replace(c[i - 1], '[.!?]+$', '')), '\s+')[-1]) NOT IN ({ABBR_SQL})) AS k FROM s)
SELECT doc_id, CAST(CASE WHEN trim(t) = '' THEN 0 ELSE 1 + len(k) END AS INT) AS n_sentences FROM w""")
def t02_sentences(spark, d):
    docs = tables.read(spark, d, "documents")
    return docs.select("doc_id", F.size(claims.sentences(F.coalesce("text", F.lit("")))).alias("n_sentences"))


_RE2 = lambda ps: "(?i)" + "|".join(ps)
_HITS = lambda ps: " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in ps)


def _texts(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


TEXT_SQL = "t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"""WITH {TEXT_SQL} SELECT doc_id, CASE WHEN regexp_matches(text, '{_RE2(claims.NEGATIVE)}') THEN 'negative' WHEN regexp_matches(text, '{_RE2(claims.POSITIVE)}') THEN 'positive' ELSE 'neutral' END AS polarity FROM t""")
def t03_polarity(spark, d):
    return _texts(spark, d).select("doc_id", claims.polarity(F.col("text")).alias("polarity"))


@query(f"""WITH {TEXT_SQL}, h AS (SELECT doc_id, {_HITS(claims.CLAIM_SIGNS)} AS c, {_HITS(claims.BACKGROUND_SIGNS)} AS b FROM t)
SELECT doc_id, CASE WHEN c >= 2 THEN 'high' WHEN c = 1 AND b = 0 THEN 'medium' WHEN c = 1 THEN 'low' END AS confidence FROM h""")
def t04_claim_confidence(spark, d):
    return _texts(spark, d).select("doc_id", claims.claim_confidence(F.col("text")).alias("confidence"))


@query()
def t05_claims(spark, d):
    return claims.extract_claims(_texts(spark, d)).withColumn("polarity_markers", F.array_join("polarity_markers", ","))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT DISTINCT doc_id, trim(unnest(CASE WHEN len(l) > 6 THEN l[1:3] || l[-3:] ELSE l END), ' ') AS line FROM l)
SELECT line, count(*) AS n_pages FROM e WHERE length(line) BETWEEN 5 AND 120 GROUP BY line HAVING count(*) >= 3""")
def t06_running_heads(spark, d):
    docs = tables.read(spark, d, "documents").select(F.lit(1).alias("doc"), "doc_id", "text")
    return layout.running_heads(docs, "doc", "doc_id").select("line", "n_pages")


@query()
def t07_sections(spark, d):
    return layout.segment_sections(tables.read(spark, d, "documents").select("doc_id", "text"), "doc_id").groupBy("id").agg(F.count(F.lit(1)).alias("n_sections"))


@query()
def t08_paragraphs(spark, d):
    docs = tables.read(spark, d, "documents")
    return docs.select("doc_id", F.size(layout.paragraphs(F.coalesce("text", F.lit("")))).alias("n_paragraphs"))


@query()
def t09_math_regions(spark, d):
    return layout.math_regions(tables.read(spark, d, "documents").select("doc_id", "text"), "doc_id").groupBy("id", "detection_type").agg(F.count(F.lit(1)).alias("n"))


# ---- patterns ----------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT p_brand AS "group", count(*) AS n, regr_slope(p_retailprice::DOUBLE, p_size::DOUBLE) AS s, min(p_retailprice)::DOUBLE AS lo, max(p_retailprice)::DOUBLE AS hi FROM part WHERE p_size IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT "group", n, round(s, 5) AS slope, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN abs(s) < 0.001 OR hi - lo < 0.05 THEN 'remains roughly constant' WHEN s > 0 THEN 'increases steadily' ELSE 'decreases steadily' END AS trend FROM g""")
def p01_group_trends(spark, d):
    t = patterns.group_trends(tables.read(spark, d, "part"), "p_brand", "p_size", "p_retailprice")
    return t.select("group", "n", F.round("slope", 5).alias("slope"), r6("lo", "lo"), r6("hi", "hi"), "trend")


@query("""WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(value) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_id, event_type, round((value - m) / s, 2) AS z FROM events JOIN m USING (event_type) WHERE n >= 3 AND s >= 1e-9 AND abs((value - m) / s) > 2.5""")
def p02_zscore_anomalies(spark, d):
    return patterns.anomalies(tables.read(spark, d, "events"), "event_type", "value").select("event_id", "event_type", "z")


@query("""WITH l AS (SELECT 'part_' || p_partkey AS source_id, lead('part_' || p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS target_id, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) - p_partkey AS step FROM part)
SELECT source_id, target_id, 'analogous_to' AS link_type, '1.5' AS confidence_tier FROM l WHERE target_id IS NOT NULL UNION ALL SELECT source_id, target_id, 'correlates_with', '2' FROM l WHERE step = 1""")
def p03_chain_links(spark, d):
    part = tables.read(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), "p_brand", "p_partkey")
    return patterns.chain_links(part, "id", "p_brand", "p_partkey", "analogous_to", "1.5").unionByName(patterns.chain_links(part, "id", "p_brand", "p_partkey", "correlates_with", "2", adjacent=True))


@query("""SELECT 'part_' || p_partkey AS entry_id, round(p_retailprice::DOUBLE, 6) AS price, TRY_CAST(CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS INT) AS size, p_type AS type FROM part""")
def p04_eav_pivot(spark, d):
    part = tables.read(spark, d, "part")
    eav = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entry_id"), F.expr(
        "stack(3, 'price', CAST(p_retailprice AS STRING), 'size', CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END, 'type', p_type) AS (property_name, property_value)"))
    return patterns.eav_wide(eav, ("price",), ("size",), ("type",)).withColumn("price", r6("price"))


@query("""SELECT p_brand AS "group", count(*) AS n, round(min(p_retailprice)::DOUBLE, 4) AS min_p, round(max(p_retailprice)::DOUBLE, 4) AS max_p, round(avg(p_retailprice::DOUBLE), 4) AS mean_p FROM part GROUP BY 1 HAVING count(*) >= 3""")
def p05_group_stats(spark, d):
    s = patterns.group_stats(tables.read(spark, d, "part"), "p_brand", ["p_retailprice"], 3, "unknown")
    return s.select("group", "n", F.round("min_p_retailprice", 4).alias("min_p"), F.round("max_p_retailprice", 4).alias("max_p"), F.round("mean_p_retailprice", 4).alias("mean_p"))


@query("""WITH c AS (SELECT p_brand AS g, lower(p_type) AS v, count(*) AS k FROM part GROUP BY 1, 2) SELECT g AS "group", string_agg(k || ' ' || v, '; ' ORDER BY k DESC, v) AS mix FROM c GROUP BY 1""")
def p06_value_mix(spark, d):
    return patterns.value_mix(tables.read(spark, d, "part"), "p_brand", "p_type")


# ---- snapshots ---------------------------------------------------------------------------------------------------


def _history(spark, d):
    """Two snapshots of the embeddings: the second lacks every 13th, adds every 11th and turns every 5th vector a little."""
    v = tables.vectors(spark, d).select(F.col("id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("entry_id"), F.transform("vec", lambda x: x.cast("double")).alias("embedding"), "id")
    one = v.filter("id % 11 <> 0").withColumn("snapshot_id", F.lit("s1"))
    turned = F.when(F.col("id") % 5 == 0, F.transform("embedding", lambda x, i: F.when(i == 0, x + 0.5).otherwise(x))).otherwise(F.col("embedding"))
    two = v.filter("id % 13 <> 0").withColumns({"embedding": turned, "snapshot_id": F.lit("s2")})
    h = one.unionByName(two)
    return h.withColumn("content_hash", F.sha2(F.concat_ws("|", "chunk_id", (F.col("id") % 5 == 0).cast("string"), F.when(F.col("id") % 5 == 0, F.col("snapshot_id"))), 256)).drop("id")


def _snapshots(spark):
    return spark.createDataFrame([("s1", "2026-01-01"), ("s2", "2026-02-01")], "snapshot_id string, created_at string")


HIST_SQL = f"""{V_SQL}, s1 AS (SELECT id, label, e FROM v WHERE id % 11 <> 0), s2 AS (SELECT id, label, CASE WHEN id % 5 = 0 THEN [e[1] + 0.5] || e[2:] ELSE e END AS e FROM v WHERE id % 13 <> 0)"""


@query(f"""WITH {HIST_SQL} SELECT CAST(coalesce(s1.id, s2.id) AS VARCHAR) AS chunk_id, CASE WHEN s1.id IS NULL THEN 'added' WHEN s2.id IS NULL THEN 'removed' WHEN s1.id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM s1 FULL JOIN s2 ON s1.id = s2.id""")
def s01_snapshot_diff(spark, d):
    h = _history(spark, d)
    return snapshots.compare(snapshots.at(h, "s1"), snapshots.at(h, "s2"))


@query(f"""WITH {HIST_SQL}, j AS (SELECT CAST(s2.id AS VARCHAR) AS chunk_id, s1.id AS old, round(1 - list_cosine_similarity(s1.e, s2.e), 6) AS d FROM s2 LEFT JOIN s1 USING (id))
SELECT chunk_id, CASE WHEN old IS NOT NULL THEN abs(round(d, 4)) END AS drift, CASE WHEN old IS NULL THEN 'new' WHEN d > 0.05 THEN 'changed' ELSE 'stable' END AS status FROM j""")
def s02_drift(spark, d):
    h = _history(spark, d)
    return snapshots.drift(snapshots.at(h, "s1"), snapshots.at(h, "s2")).withColumn("drift", F.abs(F.round("drift", 4)))


@query(f"""WITH {HIST_SQL}, n1 AS (SELECT id, list(o ORDER BY o) AS l FROM (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, CAST(b.id AS VARCHAR)) AS r FROM s1 a JOIN s1 b ON a.id <> b.id) WHERE r <= 5 GROUP BY id),
n2 AS (SELECT id, list(o ORDER BY o) AS l FROM (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, CAST(b.id AS VARCHAR)) AS r FROM s2 a JOIN s2 b ON a.id <> b.id) WHERE r <= 5 GROUP BY id)
SELECT CAST(n2.id AS VARCHAR) AS chunk_id, round(len(list_intersect(n1.l, n2.l)) / len(list_distinct(n1.l || n2.l)), 6) AS jaccard FROM n2 LEFT JOIN n1 USING (id)""")
def s03_neighbour_jaccard(spark, d):
    h = _history(spark, d)
    near = None
    for s in ("s1", "s2"):
        one = snapshots.neighbours(snapshots.at(h, s)).withColumn("snapshot_id", F.lit(s))
        near = one if near is None else near.unionByName(one)
    out = snapshots.neighbourhood_history(near, _snapshots(spark))
    return out.filter("snapshot_id = 's2'").select("chunk_id", r6("jaccard", "jaccard"))


@query(f"""WITH {HIST_SQL} SELECT CAST(id AS VARCHAR) AS chunk_id, 's2' AS snapshot_id, abs(round(1 - list_cosine_similarity(s1.e, s2.e), 4)) AS drift FROM s2 LEFT JOIN s1 USING (id)
UNION ALL SELECT CAST(id AS VARCHAR), 's1', NULL FROM s1""")
def s04_trajectory(spark, d):
    return snapshots.trajectory(_history(spark, d), _snapshots(spark)).withColumn("drift", F.abs(F.round("drift", 4)))


@query(f"""WITH {V_SQL}, c AS (SELECT label, list(x ORDER BY pos) AS m FROM (SELECT label, pos, avg(e[pos]) AS x FROM v, unnest(range(1, 65)) AS t(pos) GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(a.label AS VARCHAR) AS id, CAST(b.label AS VARCHAR) AS other, round(list_cosine_similarity(a.m, b.m), 4) AS similarity FROM c a JOIN c b ON CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR) ORDER BY list_cosine_similarity(a.m, b.m) DESC LIMIT 5""")
def s05_cluster_pairs(spark, d):
    v = tables.vectors(spark, d).select(F.lit("s").alias("snapshot_id"), F.col("label").cast("string").alias("entry_id"), F.col("vec").alias("embedding"))
    return snapshots.cluster_pairs(v, ["s"]).drop("snapshot_id")


@query(f"""WITH {HIST_SQL}, j AS (SELECT CAST(id AS VARCHAR) AS id, s1.e AS a, s2.e AS b FROM s1 JOIN s2 USING (id)),
g AS (SELECT x.id, y.id AS other, list_cosine_similarity(x.b, y.b) - list_cosine_similarity(x.a, y.a) AS g FROM j x JOIN j y ON x.id < y.id)
SELECT id, other, round(g, 4) AS gain FROM g WHERE g > 0 ORDER BY g DESC, id, other LIMIT 5""")
def s06_converging(spark, d):
    h = _history(spark, d)
    return snapshots.converging(snapshots.at(h, "s1"), snapshots.at(h, "s2"))


# ---- chart data --------------------------------------------------------------------------------------------------


@query(f"""WITH {BRIDGES_SQL} SELECT confidence_tier AS "by", CAST(least(floor((similarity - 0.6) / 0.02), 19) AS BIGINT) AS bin, count(*) AS n FROM b WHERE similarity BETWEEN 0.6 AND 1.0 GROUP BY 1, 2""")
def r01_similarity_hist(spark, d):
    return charts.histogram(_bridges(spark, d), "similarity", "confidence_tier", 0.6, 1.0, 0.02)


@query(f"""WITH {BRIDGES_SQL}, x AS (SELECT va.label AS a, vb.label AS c, count(*) AS n FROM b JOIN v va ON va.id = rrp_entry_id JOIN v vb ON vb.id = ds_entry_id GROUP BY 1, 2), y AS (SELECT a, CASE WHEN sum(n) OVER (PARTITION BY c) < 5 THEN 'Other' ELSE CAST(c AS VARCHAR) END AS c, n FROM x),
z AS (SELECT a, c, sum(n) AS n FROM y GROUP BY 1, 2) SELECT a AS "row", c AS "column", CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY c) AS BIGINT) AS column_total FROM z""")
def r02_heatmap(spark, d):
    v = tables.vectors(spark, d)
    b = _bridges(spark, d).join(v.select(F.col("id").alias("rrp_entry_id"), F.col("label").alias("a")), "rrp_entry_id").join(v.select(F.col("id").alias("ds_entry_id"), F.col("label").alias("c")), "ds_entry_id")
    return charts.heatmap(b, "a", "c")


@query(f"""WITH {BRIDGES_SQL}, k AS (SELECT ds_entry_id, CAST(row_number() OVER (ORDER BY count(*) DESC, ds_entry_id) - 1 AS DOUBLE) AS y FROM b GROUP BY 1)
SELECT 'kb' AS side, ds_entry_id AS id, y FROM k UNION ALL SELECT 'bundle', rrp_entry_id, round(avg(y), 6) FROM b JOIN k USING (ds_entry_id) GROUP BY 2""")
def r03_bipartite_layout(spark, d):
    return charts.bipartite_layout(_bridges(spark, d)).withColumn("y", r6("y"))


@query(f"""WITH {TRADE_SQL}, n AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1)
SELECT id, title, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN n USING (id) ORDER BY 3 DESC, 1 LIMIT 20""")
def r04_entry_metrics(spark, d):
    return charts.entry_metrics(*_trade(spark, d))


@query(f"WITH {BRIDGES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE confidence_tier = '1.5') AS tier_1_5, round(avg(similarity), 6) AS mean_sim, round(median(similarity), 6) AS median_sim FROM b")
def r05_bridge_stats(spark, d):
    return charts.bridge_stats(_bridges(spark, d)).select("total", "tier_1_5", r6("mean_sim", "mean_sim"), r6("median_sim", "median_sim"))
