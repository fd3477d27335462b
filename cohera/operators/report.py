"""The two-tier coherence report and its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.operators import bridges as br
from cohera.operators import fim, graph


def tier1(swept: DataFrame) -> DataFrame:
    """One row: the sweep's summary with coherence = 1 - noise / analyzed (null without an analyzed node) and verdict."""
    s = fim.sweep_summary(swept)
    coherence = F.when(F.col("n_analyzed") > 0, 1 - F.col("noise_dominated") / F.col("n_analyzed"))
    s = s.withColumn("coherence", coherence)
    verdict = F.when(F.col("coherence") >= 0.80, "INTERNALLY CONSISTENT").when(F.col("coherence") >= 0.60, "MARGINAL").otherwise("FRAGMENTED")
    return s.withColumn("verdict", verdict)


def tier2(joined_sweep: DataFrame, prefix: str = "rrp::") -> DataFrame:
    """One row over the bundle's nodes in the joined graph: bridged (analyzable there), noise and isotropic shares, verdict."""
    own = joined_sweep.filter(F.col("entry_id").startswith(prefix))
    ok = ~F.col("skipped")
    s = own.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_bridged"), F.count_if(ok & (F.col("regime") == "noise_dominated")).alias("n_noise"), F.count_if(ok & (F.col("regime") == "isotropic")).alias("n_isotropic"))
    s = s.withColumns({"bridge_frac": F.col("n_bridged") / F.greatest("n_total", F.lit(1)), "noise_frac": F.col("n_noise") / F.greatest("n_bridged", F.lit(1))})
    verdict = F.when((F.col("bridge_frac") >= 0.70) & (F.col("noise_frac") < 0.30), "WELL-INTEGRATED").when(F.col("bridge_frac") >= 0.40, "PARTIAL").otherwise("ISOLATED")
    return s.withColumn("verdict", verdict)


def score(coherence: Column, bridge_frac: Column, noise_frac: Column, mean_weight: Column) -> Column:
    return F.round(0.5 * F.coalesce(coherence, F.lit(0.0)) + 0.5 * bridge_frac * (1 - noise_frac) * mean_weight, 4)


def page_verdict(frac: Column, mean_sim: Column) -> Column:
    """The looser verdict of the tier-2 page."""
    return F.when((frac >= 0.70) & (mean_sim >= 0.80), "WELL-INTEGRATED").when((frac >= 0.40) | (mean_sim >= 0.77), "PARTIAL").otherwise("ISOLATED")


def generate(name: str, bundle: DataFrame, bundle_links: DataFrame, wiki: DataFrame, wiki_links: DataFrame, bridges: DataFrame, min_sim: float = 0.75, alpha: float = 1.0) -> DataFrame:
    """The report row: tier 1 over the bundle's graph, tier 2 over the joined graph, formality, score and summary."""
    one = tier1(fim.sweep(bundle, graph.build_graph(bundle, bundle_links), alpha=alpha))
    vertices, edges = graph.bridge_graph(bundle, bundle_links, wiki, wiki_links, bridges, min_sim)
    two = tier2(fim.sweep(vertices, edges, alpha=alpha))
    near = bridges.filter(F.col("similarity") >= min_sim)
    weight = br.formality_breakdown(near, br.formality(wiki)).agg(F.coalesce(F.max("mean_weight"), F.lit(1.0)).alias("mean_weight"))
    k = F.lit(1)
    r1 = one.select(k.alias("k"), "n_analyzed", "n_skipped", "mean_d_eff", "median_eta", "coherence", F.col("verdict").alias("tier1_verdict"))
    r2 = two.select(k.alias("k"), "n_bridged", "bridge_frac", "noise_frac", "n_isotropic", F.col("verdict").alias("tier2_verdict"))
    out = r1.join(r2, "k").join(weight.withColumn("k", k), "k").drop("k")
    out = out.withColumn("score", score(F.col("coherence"), F.col("bridge_frac"), F.col("noise_frac"), F.col("mean_weight")))
    return out.withColumn("summary", summary(F.lit(name)))


def summary(name: Column) -> Column:
    """One or two sentences from a report row's columns."""
    a = F.when(F.col("tier1_verdict") == "INTERNALLY CONSISTENT", "internally consistent").when(F.col("tier1_verdict") == "MARGINAL", "marginally structured").otherwise("structurally fragmented")
    b = F.when(F.col("tier2_verdict") == "WELL-INTEGRATED", "well integrated into").when(F.col("tier2_verdict") == "PARTIAL", "partially connected to").otherwise("largely isolated from")
    share = F.col("n_isotropic") / F.greatest("n_bridged", F.lit(1))
    note = F.when((F.col("n_bridged") > 0) & (share >= 0.25), F.format_string(" %d bridged entries (%.0f%%) are isotropic.", "n_isotropic", share * 100)).otherwise("")
    text = F.format_string(
        "%s is %s (%.0f%% non-noise) and %s the knowledge base (%.0f%% of entries reach it above threshold). Score: %.3f.",
        name, a, F.coalesce("coherence", F.lit(0.0)) * 100, b, F.col("bridge_frac") * 100, F.col("score"),
    )
    return F.concat(text, note)


def sweep_percentages(swept: DataFrame) -> DataFrame:
    """(regime, n, pct) of analyzed nodes."""
    counts = swept.filter(~F.col("skipped")).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def bridge_targets(bridges: DataFrame, wiki_sweep: DataFrame) -> DataFrame:
    """(ds_entry_id, similarity, tier, outcome) of distinct targets: structured, noise or skipped."""
    t = bridges.select("ds_entry_id", "similarity", "confidence_tier").distinct()
    j = t.join(wiki_sweep.select(F.col("entry_id").alias("ds_entry_id"), "skipped", "regime"), "ds_entry_id", "left")
    lost = F.coalesce("skipped", F.lit(True))
    return j.select("ds_entry_id", "similarity", "confidence_tier", F.when(lost, "skipped").when(F.col("regime") == "noise_dominated", "noise").otherwise("structured").alias("outcome"))


def markdown(row) -> str:
    """A report row as Markdown (one small row at the driver)."""
    d = row.asDict()
    lines = ["# Coherence report", "", d.pop("summary", ""), "", "| measure | value |", "|-|-|"]
    return "\n".join(lines + [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in d.items()])


def html(row) -> str:
    """A report row as a small HTML page."""
    from html import escape

    cells = "".join(f"<tr><th>{escape(k)}</th><td>{escape(str(v))}</td></tr>" for k, v in row.asDict().items())
    return f"<!doctype html><meta charset=utf-8><title>Coherence report</title><table>{cells}</table>"


def text_table(df: DataFrame, most: int = 50) -> str:
    """The first rows by the first column as aligned text, and how many more there are."""
    rows = [df.columns, *[[str(v) for v in r] for r in df.orderBy(F.col(f"`{df.columns[0]}`")).limit(most).collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    more = df.count() - most if len(rows) > most else 0
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join(lines + [f"... and {more} more rows"] * (more > 0))
