"""Schemas of the bundle, knowledge-base and snapshot tables, and their migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = "id string, title string, entry_type string, source_type string, domain string, status string, confidence string, authoring_status string"
SECTIONS = "entry_id string, section_name string, content string, section_order int"
LINKS = "link_type string, source_id string, source_label string, target_id string, target_label string, description string, link_order int, confidence_tier string, stoichiometry_coef double"
PROPERTIES = "entry_id string, property_name string, property_value string"
META = "key string, value string"
BRIDGES = "rrp_entry_id string, rrp_entry_title string, ds_entry_id string, ds_entry_title string, similarity double, proposed_link_type string, confidence_tier string, description string, created_at timestamp"
MATH = "entry_id string, claim_index int, formula string, plain_english string, what_it_constrains string, ds_wiki_anchor string, source_section string, human_verified boolean, created_at timestamp"
CONJECTURES = "id string, title string, claim string, depends_on string, would_confirm string, would_kill string, critical_gaps string, gate string, conjecture_order int"
GATES = "id string, claim string, priority string, blocking string"
BRIDGE_CONTENT = "section_name string, content string, section_order int"
SNAPSHOTS = "snapshot_id string, created_at timestamp, trigger string, chunk_count int, notes string, embed_model string"
HISTORY = "snapshot_id string, chunk_id string, entry_id string, content_hash string, embedding array<float>, top5_neighbors array<struct<id:string,score:double>>, centroid_distance double"
TOPOLOGY = "snapshot_id string, metric_name string, metric_value string"
FISHER = "snapshot_id string, entry_id string, graph_source string, kernel_type string, alpha double, d_eff int, participation_ratio double, disorder_index double, regime string, sv_profile array<double>, raw_sigmas array<double>, center_degree int, n_vertices int, skipped boolean, skip_reason string, computed_at timestamp"

BUNDLE = {
    "entries": ENTRIES, "sections": SECTIONS, "links": LINKS, "entry_properties": PROPERTIES, "rrp_meta": META,
    "cross_universe_bridges": BRIDGES, "math_interpretations": MATH,
}
#: Values of columns that are written without one.
DEFAULTS = {
    "entries": {"status": "established", "confidence": "Tier 2", "authoring_status": "rrp_ingested"},
    "sections": {"section_order": 0},
    "links": {"link_order": 0, "confidence_tier": "1.5"},
}
SCHEMA_VERSION = "1.2"


def conform(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """`df` with exactly the columns of `schema`: missing ones are added with their default, else null."""
    have = set(df.columns)
    out = []
    for f in T.StructType.fromDDL(schema):
        c = F.col(f.name) if f.name in have else F.lit((defaults or {}).get(f.name))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(out)
