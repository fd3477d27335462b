"""Runs that read a bundle, write their results back, and report what they did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.operators import bridges, chunks, vectors
from cohera.plans.shared import cut
from cohera.sources import bundle


def set_meta(spark: SparkSession, path: str, key: str, value: str) -> None:
    old = bundle.read_table(spark, path, "rrp_meta").filter(F.col("key") != key)
    bundle.replace_table(spark, path, "rrp_meta", old.unionByName(spark.createDataFrame([(key, value)], "key string, value string")))


def bridge_run(
    spark: SparkSession, path: str, kb: dict[str, DataFrame], threshold: float = 0.70, most: int = 3, kind: str = "cosine",
    encoder=None, kb_sweep: DataFrame | None = None, eta_threshold: float = 0.65,
) -> dict[str, object]:
    """Bridge a bundle to a knowledge base: replace its bridges, note the outcome in its meta rows, return counts.

    Stubs and entries of too little text are skipped. With `kb_sweep` the bridges are also counted by the disorder of
    their targets (trusted below `eta_threshold`); noisy ones are counted, not removed. Running it again gives the
    same tables.
    """
    own = bundle.open_bundle(spark, path)
    entries = own["entries"]
    texts = cut(chunks.embed(chunks.embed_texts(entries, own["sections"]), encoder).select("id", "vec"))
    other = chunks.embed(chunks.embed_texts(kb["entries"], kb["sections"]), encoder).select("id", "vec")
    name = lambda df, p: df.select(F.col("id").alias(f"{p}_entry_id"), F.col("title").alias(f"{p}_entry_title"))
    found = vectors.topk_bridges(texts, other, threshold, most, kind)
    found = cut(found.join(name(entries, "rrp"), "rrp_entry_id", "left").join(name(kb["entries"], "ds"), "ds_entry_id", "left"))
    bundle.replace_table(spark, path, "cross_universe_bridges", found)
    total, stubs, queried = entries.count(), entries.filter(F.col("id").isin(*chunks.STUBS)).count(), texts.count()
    stored = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rrp_entry_id").alias("e")).first()
    stats = {
        "total_entries": total, "skipped_stub": stubs, "skipped_thin": total - stubs - queried, "queried": queried,
        "bridges_stored": stored["n"], "entries_with_bridge": stored["e"],
    }
    if kb_sweep is not None:
        trusted = bridges.score_bridges(found, kb_sweep, None, eta_threshold).filter("structured").count()
        stats |= {"fisher_trusted": trusted, "fisher_noise": stored["n"] - trusted, "fisher_eta_threshold": eta_threshold}
    set_meta(spark, path, "pass2_status", f"bridges={stored['n']} entries_with_bridge={stored['e']} threshold={threshold}")
    return stats
