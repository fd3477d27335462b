"""Gaps of a bundle: properties, taxonomy values, type balance and links, ranked as enrichment priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators.coverage import TAXONOMY, filled

# How many entries of a type are expected at least.
TYPE_MINIMUMS = {
    "reference_law": 50, "method": 10, "law": 10, "open_question": 10, "constraint": 5, "instantiation": 5,
    "axiom": 3, "parameter": 3, "theorem": 3, "mechanism": 3,
}


def property_gaps(entries: DataFrame, props: DataFrame, threshold: float = 0.80, most_ids: int = 10) -> DataFrame:
    """Per (entry_type, property_name) that some entry of the type fills, but under 80 %: counts, priority, missing ids.

    The missing ids (first ten in order) come from an anti-join of the gaps' entries with the filled pairs.
    """
    typed = entries.select("id", F.coalesce("entry_type", F.lit("unknown")).alias("entry_type"))
    totals = typed.groupBy("entry_type").agg(F.count(F.lit(1)).alias("total_of_type"))
    have = filled(props).select(F.col("entry_id").alias("id"), "property_name").distinct()
    counts = have.join(typed, "id").groupBy("entry_type", "property_name").agg(F.count(F.lit(1)).alias("filled"))
    gaps = counts.join(totals, "entry_type").filter(F.col("filled") / F.col("total_of_type") < threshold)
    lost = gaps.select("entry_type", "property_name").join(typed, "entry_type").join(have, ["id", "property_name"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("entry_type", "property_name").orderBy("id"))
    ids = lost.withColumn("r", rank).filter(F.col("r") <= most_ids).groupBy("entry_type", "property_name").agg(F.sort_array(F.collect_list("id")).alias("missing_ids"))
    missing = F.col("total_of_type") - F.col("filled")
    share = missing / F.col("total_of_type")
    return gaps.join(ids, ["entry_type", "property_name"]).select(
        "entry_type", "property_name", "total_of_type", "filled", missing.alias("missing_count"), F.round(F.col("filled") / F.col("total_of_type") * 100, 1).alias("coverage_pct"),
        "missing_ids", F.when(share > 0.5, 1).when(share > 0.2, 2).otherwise(3).alias("priority"),
    )


def taxonomy_gaps(entries: DataFrame, props: DataFrame, names=TAXONOMY, threshold: float = 0.03) -> DataFrame:
    """(taxonomy_name, value, count, pct_of_filled, gap_type): values of at most 2 entries, or under 3 % of all entries."""
    n = entries.count()
    counts = filled(props).filter(F.col("property_name").isin(*names)).groupBy(F.col("property_name").alias("taxonomy_name"), F.col("property_value").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("taxonomy_name"))
    out = counts.withColumn("pct_of_filled", F.round(F.col("count") / total * 100, 1))
    out = out.filter((F.col("count") <= 2) | (F.col("count") / max(n, 1) < threshold))
    return out.withColumn("gap_type", F.when(F.col("count") <= 1, "singleton").otherwise("sparse"))


def type_balance_gaps(entries: DataFrame, minimums: dict[str, int] | None = None) -> DataFrame:
    """(entity_type, observed, expected_min, deficit) of types below their minimum (else 2 % of entries, 3 at least)."""
    expected = TYPE_MINIMUMS if minimums is None else minimums
    default = max(3, int(0.02 * entries.count()))
    counts = entries.groupBy(F.coalesce("entry_type", F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("observed"))
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("entity_type")], F.lit(default)) if expected else F.lit(default)
    out = counts.withColumn("expected_min", least.cast("long"))
    return out.withColumn("deficit", F.col("expected_min") - F.col("observed")).filter("deficit > 0")


def link_gaps(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(entry_id, entity_type, total_links, gap_type): isolated, else no_tier1, else same_type_only (3 links at least)."""
    typed = entries.select("id", F.col("entry_type"))
    ends = links.select("source_id", "target_id", F.coalesce("confidence_tier", F.lit("original")).alias("tier"))
    out = ends.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "tier").unionByName(ends.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "tier"))
    other = typed.select(F.col("id").alias("other"), F.col("entry_type").alias("other_type"))
    own = typed.select("id", F.col("entry_type").alias("own_type"))
    both = out.join(own, "id").join(other, "other", "left")
    known = F.when(F.coalesce("other_type", F.lit("")) != "", F.col("other_type"))
    agg = both.groupBy("id").agg(
        F.count(F.lit(1)).alias("total_links"), F.bool_or(F.col("tier") == "1").alias("tier1"), F.count(known).alias("known"),
        F.count_if(known == F.col("own_type")).alias("same"),
    )
    j = typed.join(agg, "id", "left").withColumn("total_links", F.coalesce("total_links", F.lit(0)).cast("long"))
    gap = F.when(F.col("total_links") == 0, "isolated").when(~F.col("tier1"), "no_tier1").when((F.col("total_links") >= 3) & (F.col("known") > 0) & (F.col("known") == F.col("same")), "same_type_only")
    return j.select(F.col("id").alias("entry_id"), F.coalesce("entry_type", F.lit("unknown")).alias("entity_type"), "total_links", gap.alias("gap_type")).filter("gap_type is not null")


def enrichment_priorities(entries: DataFrame, links: DataFrame, props: DataFrame) -> DataFrame:
    """(rank, action, target, impact_score): all gaps in one list, by falling impact, then action and target."""
    n = max(entries.count(), 1)
    p = property_gaps(entries, props).select(F.lit("add_property").alias("action"), F.concat_ws(".", "entry_type", "property_name").alias("target"), F.round(F.least(F.lit(1.0), F.col("missing_count") / n), 3).alias("impact_score"))
    b = type_balance_gaps(entries).select(F.lit("add_entry").alias("action"), F.col("entity_type").alias("target"), F.round(F.least(F.lit(1.0), F.col("deficit") / F.greatest(F.col("expected_min"), F.lit(1))), 3).alias("impact_score"))
    counts = link_gaps(entries, links).groupBy("gap_type").agg(F.count(F.lit(1)).alias("c")).filter("gap_type <> 'same_type_only'")
    iso = F.col("gap_type") == "isolated"
    x = counts.select(F.lit("add_link").alias("action"), F.when(iso, "isolated_entries").otherwise("no_tier1_entries").alias("target"), F.round(F.when(iso, F.least(F.lit(1.0), F.col("c") / n)).otherwise(F.least(F.lit(0.6), F.col("c") / n * 2)), 3).alias("impact_score"))
    t = taxonomy_gaps(entries, props).select(F.lit("add_taxonomy").alias("action"), F.concat_ws(":", "taxonomy_name", "value").alias("target"), F.when(F.col("count") <= 1, 0.4).otherwise(0.2).alias("impact_score"))
    every = p.unionByName(b).unionByName(x).unionByName(t)
    rank = F.row_number().over(Window.orderBy(F.desc("impact_score"), "action", "target"))
    return every.select(rank.cast("long").alias("rank"), "action", "target", "impact_score")
