"""Embedding snapshots: topology metrics, drift, trajectories, neighbourhoods, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators.graph import cosine
from cohera.operators.vectors import centroids, outliers, similar

CHANGED = 0.05


def latest(snapshots: DataFrame) -> str | None:
    row = snapshots.agg(F.max_by("snapshot_id", "created_at").alias("s")).first()
    return row["s"]


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def previous(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, previous_id): the next older snapshot. One row a snapshot, so one window over all of them."""
    w = Window.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.select("snapshot_id", F.lead("snapshot_id").over(w).alias("previous_id"))


def content_hash(text):
    return F.sha2(text, 256)


def at(history: DataFrame, snapshot: str) -> DataFrame:
    """One snapshot's chunks: a partition filter where history is stored by snapshot."""
    return history.filter(F.col("snapshot_id") == snapshot)


def centroid_distances(chunks: DataFrame) -> DataFrame:
    """(chunk_id, centroid_distance): 1 - cosine to the mean of all chunk vectors, rounded to 4 digits."""
    middle = centroids(chunks.select(F.lit(1).alias("k"), F.col("embedding").alias("vec")), "k").first()
    if middle is None:
        return chunks.select("chunk_id", F.lit(None).cast("double").alias("centroid_distance"))
    m = F.array(*[F.lit(float(x)) for x in middle["vec"]])
    return chunks.select("chunk_id", F.round(1 - cosine(F.col("embedding"), m), 4).alias("centroid_distance"))


def neighbours(chunks: DataFrame, most: int = 5) -> DataFrame:
    """(chunk_id, top5_neighbors array<struct<id,score>>): nearest other chunks, scores rounded to 4 digits."""
    v = chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    near = similar(v, v, None, most, other=True)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("k"), "other")))
    return near.groupBy(F.col("id").alias("chunk_id")).agg(F.transform(ranked, lambda x: F.struct(x["other"].alias("id"), F.round(-x["k"], 4).alias("score"))).alias("top5_neighbors"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, drift, status): 1 - cosine of a chunk's vectors in two snapshots; changed beyond 0.05; new without an old."""
    j = new.select("chunk_id", F.col("embedding").alias("b")).join(old.select("chunk_id", F.col("embedding").alias("a")), "chunk_id", "left")
    d = F.when(F.col("a").isNotNull(), F.round(1 - cosine(F.col("a"), F.col("b")), 6))
    return j.select("chunk_id", d.alias("drift"), F.when(F.col("a").isNull(), "new").when(d > CHANGED, "changed").otherwise("stable").alias("status"))


def drift_report(old: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    return drift(old, new).filter("drift is not null").orderBy(F.desc("drift"), "chunk_id").limit(most)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chunk_id, status) of two snapshots: added, removed, changed (another content hash) or unchanged."""
    j = a.select("chunk_id", F.col("content_hash").alias("ha")).join(b.select("chunk_id", F.col("content_hash").alias("hb")), "chunk_id", "full_outer")
    s = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").otherwise("unchanged")
    return j.select("chunk_id", s.alias("status"))


def trajectory(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(chunk_id, snapshot_id, drift) against the chunk's previous occurrence (null at its first)."""
    j = history.join(snapshots.select("snapshot_id", "created_at"), "snapshot_id")
    w = Window.partitionBy("chunk_id").orderBy("created_at", "snapshot_id")
    before = F.lag("embedding").over(w)
    return j.withColumn("before", before).select("chunk_id", "snapshot_id", F.when(F.col("before").isNotNull(), 1 - cosine(F.col("before"), F.col("embedding"))).alias("drift"))


def neighbourhood_history(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(chunk_id, snapshot_id, jaccard) of neighbour ids with the previous occurrence; null if that had none."""
    ids = F.transform("top5_neighbors", lambda x: x["id"])
    j = history.join(snapshots.select("snapshot_id", "created_at"), "snapshot_id").withColumn("ids", ids)
    before = F.lag("ids").over(Window.partitionBy("chunk_id").orderBy("created_at", "snapshot_id"))
    j = j.withColumn("before", before)
    jac = F.size(F.array_intersect("before", "ids")) / F.size(F.array_union("before", "ids"))
    return j.select("chunk_id", "snapshot_id", F.when(F.size("before") > 0, jac).alias("jaccard"))


def isolated_chunks(chunks: DataFrame) -> DataFrame:
    return outliers(chunks.select("chunk_id", "centroid_distance"), "centroid_distance").select("chunk_id", "centroid_distance", "z")


def cluster_pairs(history: DataFrame, snapshot_ids: list[str], most: int = 5) -> DataFrame:
    """(snapshot_id, id, other, similarity): each snapshot's most alike pairs of entry centroids."""
    out = None
    for s in snapshot_ids:
        c = centroids(at(history, s).select("entry_id", F.col("embedding").alias("vec")), "entry_id").withColumnRenamed("entry_id", "id")
        top = similar(c, c, None, most, above=True).orderBy(F.desc("cosine"), "id", "other").limit(most)
        one = top.select(F.lit(s).alias("snapshot_id"), "id", "other", F.round("cosine", 4).alias("similarity"))
        out = one if out is None else out.unionByName(one)
    return out


def converging(old: DataFrame, new: DataFrame, most: int = 5) -> DataFrame:
    """(id, other, gain): pairs of chunks in both snapshots whose cosine rose most, gains of over 0 in falling order.

    Over all pairs: with unit vectors a (old) and b (new) the gain of a pair is the product of (b, a) of one with
    (b, -a) of the other, so the largest gains are the nearest of such doubled vectors, whose squared length is 2.
    Chunks without a direction (null or zero vectors) in either snapshot have no pairs.
    """
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
    long = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")) > 0
    both = new.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("b")).join(old.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("a")), "id")
    both = both.filter(long(F.col("a")) & long(F.col("b"))).select("id", unit(F.col("a")).alias("a"), unit(F.col("b")).alias("b"))
    left, right = both.select("id", F.concat("b", "a").alias("vec")), both.select("id", F.concat("b", F.transform("a", lambda x: -x)).alias("vec"))
    near = similar(left, right, None, most, above=True).withColumn("gain", F.round(2 * F.col("cosine"), 4))
    return near.filter("cosine > 0").orderBy(F.desc("cosine"), "id", "other").limit(most).select("id", "other", "gain")


def topology(new: DataFrame, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """All metrics of a snapshot: centroid distances, neighbours, isolated chunks, and against an old one drift and
    converging pairs."""
    d = centroid_distances(new)
    out = {"centroid_distances": d, "neighbours": neighbours(new), "isolated": isolated_chunks(d)}
    if old is not None:
        out |= {"drift": drift(old, new), "converging": converging(old, new)}
    return out
