"""Bridges between a bundle and the knowledge base: trust, domain boundaries, polarity, anchors, formality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Link types by how they may cross domains.
CROSS_DOMAIN = ("analogous to", "couples to", "tests")
SAME_DOMAIN = ("derives from", "generalizes", "implements", "constrains")
TENSION = ("tensions with", "predicts for")

# Pairs of neighbouring domains.
ADJACENT = [
    ("physics", "chemistry"), ("physics", "mathematics"), ("physics", "cosmology"), ("physics", "information"), ("physics", "geometry"),
    ("chemistry", "biology"), ("chemistry", "earth sciences"), ("mathematics", "computer science"), ("mathematics", "information"),
    ("mathematics", "formal logic"), ("mathematics", "geometry"), ("formal logic", "computer science"), ("formal logic", "information"),
    ("computer science", "information"), ("biology", "networks"), ("physics", "networks"), ("earth sciences", "physics"),
    ("earth sciences", "biology"), ("earth sciences", "astronomy"),
]

# Polarity of link types.
POLARITY = {
    "would_have_violated": -1.0, "contradicted": -1.0, "explains_anomaly_in": -0.5, "introduced_undetected_error_in": -0.4,
    "is_consistent_with": 1.0, "independently_validates": 0.8, "supports": 0.7, "supersedes": 0.5, "bounds_uncertainty_of": 0.3,
}

# Fixed values by formality tier: weight, and the disorder below which a bridge is structured.
FORMALITY_WEIGHT, ETA_LIMIT = {1: 1.0, 2: 0.85, 3: 0.70}, {1: 0.60, 2: 0.65, 3: 0.75}


def _by_tier(values: dict, tier: Column, default: int = 2) -> Column:
    out = F.lit(values[default])
    for k, v in values.items():
        out = F.when(tier == k, v).otherwise(out)
    return out


def formality(kb: DataFrame | None) -> DataFrame | None:
    """(id, formality_tier) where the column exists and isn't null; None without the column."""
    if kb is None or "formality_tier" not in kb.columns:
        return None
    return kb.filter("formality_tier is not null").select("id", F.col("formality_tier").cast("int").alias("formality_tier"))


def score_bridges(bridges: DataFrame, swept: DataFrame, tiers: DataFrame | None = None, eta_threshold: float | None = None) -> DataFrame:
    """Bridges with eta, regime, tier, trust = (1 - eta) x similarity x weight, and structured.

    An anchor that is absent or was skipped has eta 1 and is degenerate. A threshold given replaces the tiers' limits.
    """
    sw = swept.filter(~F.col("skipped")).select(F.col("entry_id").alias("ds_entry_id"), F.col("disorder_index").alias("eta"), "regime")
    out = bridges.join(sw, "ds_entry_id", "left")
    if tiers is not None:
        out = out.join(tiers.select(F.col("id").alias("ds_entry_id"), "formality_tier"), "ds_entry_id", "left")
    else:
        out = out.withColumn("formality_tier", F.lit(None).cast("int"))
    tier = F.coalesce("formality_tier", F.lit(2))
    eta = F.coalesce("eta", F.lit(1.0))
    limit = _by_tier(ETA_LIMIT, tier) if eta_threshold is None else F.lit(eta_threshold)
    return out.withColumns({
        "formality_tier": tier, "structured": eta < limit, "trust": (1 - eta) * F.col("similarity") * _by_tier(FORMALITY_WEIGHT, tier),
        "regime": F.coalesce("regime", F.lit("degenerate")), "eta": eta,
    })


def filter_bridges(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structured, noise), most trusted first."""
    order = (F.desc("trust"), "rrp_entry_id", "ds_entry_id")
    return scored.filter("structured").orderBy(*order), scored.filter("not structured").orderBy(*order)


def all_domains(c: Column) -> Column:
    """Lower-cased parts of a domain text, split at ' · ' and commas; null or empty is unknown."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, ",", " · "), " · "), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("unknown"))).otherwise(F.array_distinct(parts))


def check_domains(bridges: DataFrame, link_type: str = "proposed_link_type", source: str = "source_domain", target: str = "target_domain") -> DataFrame:
    """Bridges with status and reason: tension and cross-domain types are valid; same-domain types only between equal or
    adjacent domains, else a warning; other types a warning. A null type counts as 'couples to'."""
    kind = F.coalesce(F.col(link_type), F.lit("couples to"))
    table = F.array(*[F.lit(f"{x}|{y}") for a, b in ADJACENT for x, y in ((a, b), (b, a))])
    near = F.exists(all_domains(F.col(source)), lambda a: F.exists(all_domains(F.col(target)), lambda b: (a == b) | F.array_contains(table, F.concat(a, F.lit("|"), b))))
    known = kind.isin(*TENSION) | kind.isin(*CROSS_DOMAIN)
    same = kind.isin(*SAME_DOMAIN)
    quoted = F.concat(F.lit("'"), kind, F.lit("'"))
    reason = (
        F.when(kind.isin(*TENSION), "tension type, cross-domain is expected")
        .when(kind.isin(*CROSS_DOMAIN), F.concat(quoted, F.lit(" freely crosses domain boundaries")))
        .when(same & near, F.concat(quoted, F.lit(" within same or adjacent domains")))
        .when(same, F.concat(quoted, F.lit(" crosses non-adjacent domains: "), F.coalesce(F.col(source), F.lit("")), F.lit(" to "), F.coalesce(F.col(target), F.lit(""))))
        .otherwise(F.concat(F.lit("unclassified link type "), quoted))
    )
    return bridges.withColumns({"status": F.when(known | (same & near), "valid").otherwise("warning"), "reason": reason})


def domain_summary(checked: DataFrame, target: str = "target_domain") -> DataFrame:
    """One row: bridges, valid, warnings, violations, and the sorted domains reached but unknown."""
    return checked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "valid").alias("n_valid"), F.count_if(F.col("status") == "warning").alias("n_warning"),
        F.count_if(F.col("status") == "violation").alias("n_violation"),
        F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(all_domains(F.col(target))))), F.array(F.lit("unknown")))).alias("domain_coverage"),
    )


def polarity(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])[kind], F.lit(0.0))


def alignment_label(net: Column) -> Column:
    return F.when(net > 0.3, "aligned").when(net < -0.3, "contested").otherwise("neutral")


def aligned_bridges(entries: DataFrame, links: DataFrame, bridges: DataFrame) -> DataFrame:
    """(entry_id, ds_entry_id, similarity, polarity, score, hops): direct bridges with the entry's own polarity, and
    two-hop ones over a link of some polarity. A two-hop path takes a direct bridge's place if it says more (the one of
    largest absolute polarity); otherwise paths are kept as they are, repeated ones too."""
    p = links.withColumn("p", polarity(F.col("link_type"))).filter("p <> 0").select("source_id", "target_id", "p")
    own = p.groupBy(F.col("source_id").alias("entry_id")).agg(F.avg("p").alias("own"))
    b = bridges.select(F.col("rrp_entry_id").alias("entry_id"), "ds_entry_id", "similarity")
    direct = b.join(own, "entry_id", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    hop = p.join(b.withColumnRenamed("entry_id", "target_id"), "target_id").select(F.col("source_id").alias("entry_id"), "ds_entry_id", "similarity", "p")
    strongest = hop.groupBy("entry_id", "ds_entry_id").agg(F.max_by(F.struct("p", "similarity"), F.struct(F.abs("p"), F.col("p"), F.col("similarity"))).alias("h"))
    d = direct.join(strongest, ["entry_id", "ds_entry_id"], "left")
    wins = F.col("h").isNotNull() & (F.abs(F.col("h.p")) > F.abs("own"))
    one = d.select("entry_id", "ds_entry_id", "similarity", F.when(wins, F.col("h.p")).otherwise(F.col("own")).alias("polarity"), F.when(wins, 2).otherwise(1).alias("hops"))
    two = hop.join(direct.select("entry_id", "ds_entry_id"), ["entry_id", "ds_entry_id"], "left_anti").select("entry_id", "ds_entry_id", "similarity", F.col("p").alias("polarity"), F.lit(2).alias("hops"))
    every = one.unionByName(two).join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    return every.withColumn("score", F.col("polarity") * F.col("similarity"))


def entry_alignment(paths: DataFrame) -> DataFrame:
    """(entry_id, n_bridges, net_polarity, label): mean polarity of the bridges beyond 0.1."""
    net = F.coalesce(F.avg(F.when(F.abs("polarity") > 0.1, F.col("polarity"))), F.lit(0.0))
    return paths.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_bridges"), net.alias("net_polarity")).withColumn("label", alignment_label(F.col("net_polarity")))


def paper_alignment(per_entry: DataFrame) -> DataFrame:
    net = F.coalesce(F.avg(F.when(F.abs("net_polarity") > 0.1, F.col("net_polarity"))), F.lit(0.0))
    return per_entry.agg(F.count(F.lit(1)).alias("n_entries"), net.alias("paper_polarity"))


def kb_alignment(paths: DataFrame) -> DataFrame:
    """(ds_entry_id, mean_score): mean signed score of paths with a polarity."""
    return paths.filter("polarity <> 0").groupBy("ds_entry_id").agg(F.avg("score").alias("mean_score"))


def top_paths(paths: DataFrame, n: int = 3, contested: bool = True) -> DataFrame:
    """Each entry's most contested (or aligned) bridges."""
    side = paths.filter("score < 0" if contested else "score > 0")
    order = F.col("score") if contested else F.desc("score")
    return side.withColumn("rank", F.row_number().over(Window.partitionBy("entry_id").orderBy(order, "ds_entry_id"))).filter(F.col("rank") <= n)


def anchor_load(bridge_edges: DataFrame, n: int = 10) -> DataFrame:
    """(ds_entry_id, n_bridges): KB entries by merged bridge edges."""
    edges = bridge_edges.select("rrp_entry_id", "ds_entry_id").distinct()
    return edges.groupBy("ds_entry_id").agg(F.count(F.lit(1)).alias("n_bridges")).orderBy(F.desc("n_bridges"), "ds_entry_id").limit(n)


def reach(entries: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row: unique anchors, entries with a bridge, all entries, coverage."""
    b = bridges.agg(F.countDistinct("ds_entry_id").alias("unique_anchors"), F.countDistinct("rrp_entry_id").alias("covered")).withColumn("k", F.lit(1))
    e = entries.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    return b.join(e, "k").drop("k").withColumn("coverage", F.col("covered") / F.greatest(F.col("total"), F.lit(1)))


def formality_breakdown(bridges: DataFrame, tiers: DataFrame | None) -> DataFrame:
    """(formality_tier, n_anchors, mean_weight): anchors reached, not bridges; mean_weight over all of them (1 if none)."""
    anchors = bridges.select(F.col("ds_entry_id").alias("id")).distinct()
    j = anchors.join(tiers, "id", "left") if tiers is not None else anchors.withColumn("formality_tier", F.lit(None).cast("int"))
    j = j.withColumn("formality_tier", F.coalesce("formality_tier", F.lit(2)))
    counts = j.groupBy("formality_tier").agg(F.count(F.lit(1)).alias("n_anchors"))
    w = _by_tier(FORMALITY_WEIGHT, F.col("formality_tier"))
    every = Window.partitionBy()
    return counts.withColumn("mean_weight", F.sum(w * F.col("n_anchors")).over(every) / F.sum("n_anchors").over(every))


def strongest(bridges: DataFrame, n: int = 10) -> DataFrame:
    return bridges.orderBy(F.desc("similarity"), "rrp_entry_id", "ds_entry_id").limit(n)
