"""Coverage of a bundle: distributions, property and section coverage, network metrics, dataset fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Properties whose gaps are reported, and the share below which a value is sparse.
TAXONOMY = ("mathematical_archetype", "dimensional_sensitivity", "concept_tags")
SPARSE = 0.03


def _shown(c: str):
    return F.coalesce(F.col(c), F.lit("unknown"))


def distribution(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """(value, n) of a column, nulls as `missing`."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bundle_stats(entries: DataFrame, links: DataFrame, sections: DataFrame, props: DataFrame, bridges: DataFrame, maths: DataFrame) -> DataFrame:
    """One row: rows of each table, and entries without a link."""
    named = {"entries": entries, "links": links, "sections": sections, "properties": props, "bridges": bridges, "math_interpretations": maths, "isolated": isolated(entries, links)}
    parts = None
    for name, df in named.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy().agg(*[F.max(F.when(F.col("name") == k, F.col("n"))).alias(k) for k in named])


def isolated(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Ids of entries at neither end of a link."""
    ends = links.select(F.explode(F.array("source_id", "target_id")).alias("end")).distinct()
    return entries.select("id").join(ends, F.col("id") == F.col("end"), "left_anti")


def section_stats(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """(entry_type, n_entries, n_sections, avg_sections) with entries that have no section."""
    joined = entries.select("id", _shown("entry_type").alias("entry_type")).join(sections.select("entry_id"), F.col("id") == F.col("entry_id"), "left")
    out = joined.groupBy("entry_type").agg(F.countDistinct("id").alias("n_entries"), F.count("entry_id").alias("n_sections"))
    return out.withColumn("avg_sections", F.round(F.col("n_sections") / F.col("n_entries"), 1))


def filled(props: DataFrame) -> DataFrame:
    return props.filter("property_value is not null and property_value <> ''")


def property_coverage(entries: DataFrame, props: DataFrame) -> DataFrame:
    """(property_name, filled, total_entities, coverage_pct)."""
    n = entries.count()
    out = props.groupBy("property_name").agg(F.countDistinct(F.when((F.col("property_value").isNotNull()) & (F.col("property_value") != ""), F.col("entry_id"))).alias("filled"))
    return out.select("property_name", "filled", F.lit(n).cast("long").alias("total_entities"), F.round(F.col("filled") / max(n, 1) * 100, 1).alias("coverage_pct"))


def vocabulary(entries: DataFrame, props: DataFrame) -> DataFrame:
    """(property_name, property_value, n, sparse): sparse where fewer than 3 % of all entries have the value."""
    n = entries.count()
    out = filled(props).groupBy("property_name", "property_value").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("sparse", F.col("n") < SPARSE * n)


def archetypes(props: DataFrame) -> DataFrame:
    return props.filter(F.col("property_name") == TAXONOMY[0]).groupBy(F.col("property_value").alias("archetype")).agg(F.count(F.lit(1)).alias("n"))


def sensitivity(entries: DataFrame, props: DataFrame) -> DataFrame:
    """(value, n) of the lower-cased sensitivity, with `missing`: entries less property rows."""
    rows = props.filter(F.col("property_name") == TAXONOMY[1]).select(F.lower("property_value").alias("value"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    n, r = entries.count(), rows.count()
    missing = entries.sparkSession.range(1).select(F.lit("missing").alias("value"), F.lit(n - r).cast("long").alias("n"))
    return counts.unionByName(missing)


def network_metrics(entries: DataFrame, links: DataFrame) -> DataFrame:
    """One row: entries, links, possible pairs, density (6 digits), links an entry (2 digits), isolated entries."""
    n, m, iso = entries.count(), links.count(), isolated(entries, links).count()
    possible = n * (n - 1) // 2
    return entries.sparkSession.range(1).select(
        F.lit(n).cast("long").alias("n_entries"), F.lit(m).cast("long").alias("n_links"), F.lit(possible).cast("long").alias("possible_pairs"),
        F.round(F.lit(m / possible if possible else 0.0), 6).alias("link_density"), F.round(F.lit(m / n if n else 0.0), 2).alias("avg_links"),
        F.lit(iso).cast("long").alias("isolated_count"),
    )


def compact_stats(entries: DataFrame, links: DataFrame, gap_count: int = 0) -> DataFrame:
    """The network row with the first 10 isolated ids, the 5 largest domains and the number of gaps."""
    iso = isolated(entries, links).orderBy("id").limit(10).agg(F.sort_array(F.collect_list("id")).alias("first_isolated"))
    dom = distribution(entries, "domain").orderBy(F.desc("n"), "value").limit(5)
    dom = dom.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "value"))), lambda x: x["value"]).alias("top_domains"))
    one = network_metrics(entries, links).withColumn("k", F.lit(1))
    return one.join(iso.withColumn("k", F.lit(1)), "k").join(dom.withColumn("k", F.lit(1)), "k").drop("k").withColumn("gap_count", F.lit(gap_count))


def gap_texts(entries: DataFrame, links: DataFrame, props: DataFrame) -> DataFrame:
    """(rule, subject, text): the six coverage warnings."""
    noun = lambda c, a, b: F.when(c == 1, a).otherwise(b)
    n = entries.count()
    net = network_metrics(entries, links)
    cov = property_coverage(entries, props).filter(F.col("property_name").isin(*TAXONOMY) & (F.col("coverage_pct") < 100))
    lost = F.col("total_entities") - F.col("filled")
    one = cov.select(F.lit(1).alias("rule"), F.col("property_name").alias("subject"), F.format_string("Property '%s': %d %s missing (%.1f%% covered).", "property_name", lost, noun(lost, "entity", "entities"), "coverage_pct").alias("text"))
    arch = archetypes(props).withColumn("pct", F.col("n") / max(n, 1) * 100).filter(F.col("pct") < SPARSE * 100)
    two = arch.select(F.lit(2).alias("rule"), F.col("archetype").alias("subject"), F.format_string("Archetype '%s' under-represented: only %d %s (%.1f%%).", "archetype", "n", noun(F.col("n"), "entry", "entries"), "pct").alias("text"))
    iso = F.col("isolated_count") / max(n, 1) * 100
    three = net.filter(iso > 20).select(F.lit(3).alias("rule"), F.when(iso > 40, "high").otherwise("some").alias("subject"), F.format_string("%d entities (%.1f%%) have no links.", "isolated_count", iso).alias("text"))
    dom = distribution(entries, "domain").withColumn("pct", F.col("n") / max(n, 1) * 100).filter("pct < 2.0")
    four = dom.select(F.lit(4).alias("rule"), F.col("value").alias("subject"), F.format_string("Domain '%s' has only %d %s (%.1f%%).", "value", "n", noun(F.col("n"), "entry", "entries"), "pct").alias("text"))
    five = distribution(entries, "entry_type").filter("n = 1").select(F.lit(5).alias("rule"), F.col("value").alias("subject"), F.format_string("Entity type '%s' has only one entry.", "value").alias("text"))
    six = net.filter("link_density < 0.01").select(F.lit(6).alias("rule"), F.lit("density").alias("subject"), F.format_string("Link density is very low (%.4f).", "link_density").alias("text"))
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).unionByName(six)


def dataset_fingerprint(entries: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row: the signals of a bundle's bridges, and the first matching dataset type with its confidence."""
    b = bridges.agg(F.count(F.lit(1)).alias("total_bridges"), F.count_if(F.col("confidence_tier") == "1.5").alias("n15"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean"))
    hub = bridges.groupBy("ds_entry_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("hub"))
    src = entries.agg(F.countDistinct("source_type").alias("source_type_count"))
    one = lambda df: df.withColumn("k", F.lit(1))
    j = one(b).join(one(hub), "k").join(one(src), "k")
    total = F.greatest(F.col("total_bridges"), F.lit(1))
    j = j.withColumns({"ratio": F.col("n15") / total, "hub_frac": F.col("hub") / total})
    few = F.col("source_type_count") <= 2
    rule = (
        F.when(F.col("total_bridges") == 0, F.struct(F.lit("unknown").alias("t"), F.lit(0.0).alias("c")))
        .when((F.col("ratio") < 0.01) & (F.col("mean") < 0.808) & few, F.struct(F.lit("entity_catalog").alias("t"), F.lit(0.85).alias("c")))
        .when((F.col("ratio") > 0.02) & (F.col("source_type_count") >= 3), F.struct(F.lit("law_catalog").alias("t"), F.lit(0.85).alias("c")))
        .when((F.col("hub_frac") > 0.5) & few, F.struct(F.lit("entity_catalog").alias("t"), F.lit(0.7).alias("c")))
        .otherwise(F.struct(F.lit("unknown").alias("t"), F.lit(0.5).alias("c")))
    )
    j = j.withColumn("rule", rule)
    return j.select(
        F.col("rule.t").alias("dataset_type"), F.col("rule.c").alias("confidence"), F.round("ratio", 4).alias("tier_1_5_ratio"), F.round("mean", 4).alias("mean_sim"),
        "source_type_count", F.round("hub_frac", 4).alias("max_hub_frac"), "total_bridges",
    )
