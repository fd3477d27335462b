"""Patterns in catalogs of items: trends, group statistics, anomalies, chains; EAV to wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Properties of elements that are measured, and those that identify.
MEASURED = ("electronegativity_pauling", "first_ionization_energy_kJ_mol", "density_g_cm3", "melting_point_K", "boiling_point_K", "electron_affinity_kJ_mol", "atomic_mass_u")
GROUPING = ("group", "period")
# Categories of at most 8 members that are linked throughout.
SMALL_CATEGORIES = ("alkali metal", "alkaline earth metal", "noble gas", "diatomic nonmetal", "metalloid")


def eav_wide(props: DataFrame, measured: tuple[str, ...], integers: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """(entry_id, one column a property): numbers by try_cast, so what isn't one is null; absent properties are null."""
    names = [*measured, *integers, *texts]
    wide = props.groupBy("entry_id").pivot("property_name", names).agg(F.first("property_value"))
    casts = [F.col(f"`{c}`").try_cast("double").alias(c) for c in measured]
    casts += [F.col(f"`{c}`").try_cast("double").cast("int").alias(c) for c in integers] + [F.col(f"`{c}`") for c in texts]
    return wide.select("entry_id", *casts)


def trend_label(slope: Column, span: Column) -> Column:
    flat = (F.abs(slope) < 0.001) | (span < 0.05)
    return F.when(flat, "remains roughly constant").when(slope > 0, "increases steadily").otherwise("decreases steadily")


def group_trends(rows: DataFrame, group: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, slope, lo, hi, first, last, trend): least-squares slope of y over x in groups of 3 points at least.

    first and last are the y of the smallest and largest x.
    """
    ok = rows.filter(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    out = ok.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.min(y).cast("double").alias("lo"), F.max(y).cast("double").alias("hi"),
        F.min_by(F.col(y), F.struct(x, y)).cast("double").alias("first"), F.max_by(F.col(y), F.struct(x, y)).cast("double").alias("last"),
    ).filter(F.col("n") >= least)
    slope = F.coalesce("slope", F.lit(0.0))
    return out.withColumn("trend", trend_label(slope, F.col("hi") - F.col("lo")))


def group_stats(rows: DataFrame, group: str, values: list[str], least: int = 1, skip_prefix: str | None = None) -> DataFrame:
    """(group, n, min/max/mean of each value): of groups of `least` members; groups that begin with a prefix stay out."""
    ok = rows.filter(F.col(group).isNotNull() & (F.trim(F.col(group).cast("string")) != ""))
    if skip_prefix:
        ok = ok.filter(~F.lower(F.col(group)).startswith(skip_prefix))
    aggs = [f(F.col(v).cast("double")).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return ok.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), *aggs).filter(F.col("n") >= least)


def value_mix(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mix): '3 solid; 1 gas', most frequent first, nulls and empty values left out."""
    counts = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(F.col(group).alias("group"), F.lower(F.col(value)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "v"))), lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), x["v"]))
    return counts.groupBy("group").agg(F.array_join(parts, "; ").alias("mix"))


def anomalies(rows: DataFrame, group: str, value: str, limit: float = 2.5, least: int = 3) -> DataFrame:
    """Rows with |z| over 2.5 within their group (population deviation, 3 values at least): z, expected, actual.

    The moments are one row a group, joined back, so a large group is never sorted or gathered.
    """
    ok = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    v = F.col(value).cast("double")
    m = ok.groupBy(F.col(group).alias("_g")).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"), F.count(F.lit(1)).alias("_n"))
    m = m.filter((F.col("_n") >= least) & (F.col("_s") >= 1e-9))
    z = (v - F.col("_m")) / F.col("_s")
    out = ok.join(m, F.col(group) == F.col("_g")).withColumn("z", z).filter(F.abs("z") > limit)
    return out.withColumns({"z": F.round("z", 2), "expected": F.round("_m", 4), "actual": F.round(v, 4)}).drop("_g", "_m", "_s", "_n")


def chain_links(rows: DataFrame, id_col: str, group: str, order: str, kind: str, tier: str, adjacent: bool = False) -> DataFrame:
    """(source_id, target_id, link_type, confidence_tier): consecutive members of each group; adjacent: only if the
    order differs by one."""
    w = Window.partitionBy(group).orderBy(order, id_col)
    nxt = rows.filter(F.col(group).isNotNull()).select(F.col(id_col).alias("source_id"), F.lead(id_col).over(w).alias("target_id"), (F.lead(order).over(w) - F.col(order)).alias("step"))
    nxt = nxt.filter("target_id is not null")
    if adjacent:
        nxt = nxt.filter("step = 1")
    return nxt.select("source_id", "target_id", F.lit(kind).alias("link_type"), F.lit(tier).alias("confidence_tier"))


def mesh_links(rows: DataFrame, id_col: str, category: str, kind: str, tier: str, most: int = 8, only: tuple[str, ...] | None = None) -> DataFrame:
    """All pairs within categories of at most `most` members (so at most 28 pairs each); 'unknown' ones stay out."""
    c = F.lower(F.trim(F.col(category)))
    ok = rows.select(F.col(id_col).alias("id"), c.alias("c")).filter("c is not null and not startswith(c, 'unknown')")
    if only is not None:
        ok = ok.filter(F.col("c").isin(*only))
    small = ok.groupBy("c").count().filter(F.col("count") <= most).select("c")
    ok = ok.join(small, "c", "left_semi")
    both = ok.withColumnRenamed("id", "source_id").join(ok.withColumnRenamed("id", "target_id"), "c").filter("source_id < target_id")
    return both.select("source_id", "target_id", F.lit(kind).alias("link_type"), F.lit(tier).alias("confidence_tier"))


def element_links(elements: DataFrame) -> DataFrame:
    """Group chains, period neighbours and small-category meshes of (id, number, group, period, category), each pair and
    type once."""
    every = chain_links(elements, "id", "group", "number", "analogous_to", "1.5")
    every = every.unionByName(chain_links(elements, "id", "period", "number", "correlates_with", "2", adjacent=True))
    every = every.unionByName(mesh_links(elements, "id", "category", "analogous_to", "1.5", only=SMALL_CATEGORIES))
    return every.groupBy(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), "link_type").agg(F.min("confidence_tier").alias("confidence_tier"))


def pattern_entries(trends: DataFrame, kind: str, domain: str) -> DataFrame:
    """Synthetic entries (id, title, entry_type, source_type, domain) for trend rows; they get no links, so the bundle's
    share of isolated entries rises."""
    slugged = F.regexp_replace(F.lower(F.col("group").cast("string")), "[^a-z0-9]+", "_")
    return trends.select(
        F.concat(F.lit(f"pat_{kind}_"), slugged, F.lit("_trend")).alias("id"), F.concat(F.lit(f"{kind.title()} "), F.col("group").cast("string"), F.lit(" trends ("), "n", F.lit(" members)")).alias("title"),
        F.lit("reference_law").alias("entry_type"), F.lit("derived_pattern").alias("source_type"), F.lit(domain).alias("domain"),
    )


def pattern_rows(entries: DataFrame) -> DataFrame:
    """Synthetic entries by id; `_` is a wildcard in LIKE."""
    return entries.filter(F.col("id").like("pat_%"))
