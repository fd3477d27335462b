"""Vector search: exact nearest neighbours and similar pairs in blocks, centroids, surprise, link candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohera.plans.shared import written

#: Bytes of vectors that are broadcast at once; larger sides are worked off in blocks.
BLOCK_BYTES = 128_000_000


def score_to_tier(sim: Column) -> Column:
    return F.when(sim >= 0.90, "1").when(sim >= 0.85, "1.5").otherwise("2")


def propose_link(sim: Column) -> Column:
    """(type, tier) of a bridge of this similarity."""
    pair = lambda a, b: F.struct(F.lit(a).alias("link_type"), F.lit(b).alias("tier"))
    return F.when(sim >= 0.85, pair("analogous to", "1.5")).when(sim >= 0.75, pair("couples to", "2")).otherwise(pair("related", "2"))


def channel_tier(sim: Column) -> Column:
    return F.when(sim >= 0.85, "tier-1").when(sim >= 0.75, "tier-1.5").otherwise("tier-2")


def similarity(cosine: Column, kind: str = "cosine") -> Column:
    """`cosine`, or `half_shift`: (1 + cosine) / 2."""
    return cosine if kind == "cosine" else (1 + cosine) / 2


def _blocks(df: DataFrame, bytes_a_row: int) -> Iterator[tuple[np.ndarray, list]]:
    """(unit vectors, ids) of a side in blocks of bounded size."""
    n = df.count()
    parts = max(1, -(-n * bytes_a_row // BLOCK_BYTES))
    kept = df if parts == 1 else written(df, "vectors")
    for k in range(parts):
        rows = (kept if parts == 1 else kept.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)).orderBy("id").toArrow()
        if rows.num_rows:
            yield _unit(rows.column("vec").to_pylist()), rows.column("id").to_pylist()


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def similar(left: DataFrame, right: DataFrame, least: float | None = None, most: int | None = None, other: bool = False, above: bool = False) -> DataFrame:
    """(id, other, cosine) of rows (id, vec) of two sides: all pairs of at least `least`, and/or each id's `most` best.

    Exact: blocks of `right` are broadcast one after another and multiplied with the batches of `left`, so no pair is
    a row before it has passed. other: skip pairs of equal ids; above: only pairs with id < other. Null vectors are
    left out. Ties go to the smaller id.
    """
    spark = left.sparkSession
    left, right = (x.select("id", "vec").filter("vec is not null") for x in (left, right))
    a, b = left.schema["id"].dataType, right.schema["id"].dataType
    schema = T.StructType([T.StructField("id", a), T.StructField("other", b), T.StructField("cosine", T.DoubleType())])
    head = right.select(F.size("vec").alias("d")).first()
    out = None
    for block in _blocks(right, 8 * (head["d"] if head else 1)):
        made = left.mapInArrow(_matcher(spark.sparkContext.broadcast(block), least, most, other, above), schema)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return spark.createDataFrame([], schema)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
        out = out.withColumn("r", rank).filter(F.col("r") <= most).drop("r")
    return out


def _matcher(block, least: float | None, most: int | None, other: bool, above: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, ids = block.value
        keys = np.array(ids)
        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = part.column(0).to_pylist()
                sims = _unit(part.column(1).to_pylist()) @ right.T
                if other or above:
                    mine = np.array(own)
                    sims[(mine[:, None] >= keys[None, :]) if above else (mine[:, None] == keys[None, :])] = -np.inf
                keep = np.isfinite(sims) if least is None else sims >= least
                if most is not None and sims.shape[1] > most:
                    cut = np.partition(sims, -most, axis=1)[:, -most]
                    keep &= sims >= cut[:, None]
                i, j = np.nonzero(keep)
                right_kind = pa.array(ids[:1]).type
                yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in i], kinds), pa.array([ids[x] for x in j], right_kind), pa.array(sims[i, j])], ["id", "other", "cosine"])

    return run


def centroids(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): mean of a key's vectors, at unit length; summed by position, so no vector list is gathered."""
    pos = rows.select(F.col(key).alias("key"), F.posexplode(vec).alias("pos", "x"))
    mean = pos.groupBy("key", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = mean.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.select(F.col("key").alias(key), F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vec"))


def topk_bridges(bundle: DataFrame, kb: DataFrame, threshold: float = 0.70, most: int = 3, kind: str = "cosine", bundle_name: str = "bundle") -> DataFrame:
    """Bridges of each bundle entry to its best KB entries: similarity, proposed type, tier and description."""
    least = threshold if kind == "cosine" else 2 * threshold - 1
    near = similar(bundle, kb, least, most)
    sim = similarity(F.col("cosine"), kind)
    out = near.select(F.col("id").alias("rrp_entry_id"), F.col("other").alias("ds_entry_id"), sim.alias("similarity"))
    p = propose_link(F.col("similarity"))
    text = F.format_string(f"{bundle_name}: similarity %.4f", "similarity")
    return out.select("rrp_entry_id", "ds_entry_id", "similarity", p["link_type"].alias("proposed_link_type"), p["tier"].alias("confidence_tier"), text.alias("description"))


def best_chunks(chunks: DataFrame, queries: DataFrame, candidates: int = 10, kind: str = "half_shift") -> DataFrame:
    """(id, entry_id, similarity): each query's best chunk a KB entry, among its `candidates` nearest chunks.

    Before a reranker 20 candidates are asked for instead of 10.
    """
    near = similar(queries, chunks.select(F.col("chunk_id").alias("id"), "vec"), None, candidates)
    named = near.join(chunks.select(F.col("chunk_id").alias("other"), "entry_id"), "other")
    return named.groupBy("id", "entry_id").agg(F.max(similarity(F.col("cosine"), kind)).alias("similarity"))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """`candidates` (id, entry_id, similarity) in the order of a cross-encoder's `scores` (id, entry_id, score).

    rerank_score and rerank_rank (0 for the best of an id, ties by entry_id) are added; similarity stays the cosine
    that thresholds are meant for. A candidate without a score ranks last.
    """
    j = candidates.join(scores.select("id", "entry_id", F.col("score").cast("double").alias("rerank_score")), ["id", "entry_id"], "left")
    best = Window.partitionBy("id").orderBy(F.desc_nulls_last("rerank_score"), "entry_id")
    return j.withColumn("rerank_rank", F.row_number().over(best) - 1)


def linked_pairs(links: DataFrame) -> DataFrame:
    return links.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().withColumn("linked", F.lit(True))


def surprising_pairs(entries: DataFrame, vectors: DataFrame, links: DataFrame, least_sim: float = 0.80, least_surprise: float = 1.15, most: int = 200, include_linked: bool = False, least_pairs: int = 5) -> DataFrame:
    """Pairs more alike than their types' mean (the global mean under five pairs): similarity, baseline, surprise.

    Baselines take in all pairs, as sums of block products by type; only pairs over `least_sim` become rows.
    """
    typed = entries.select("id", F.coalesce("entry_type", F.lit("unknown")).alias("entry_type"))
    base = type_pair_baselines(typed, vectors, least_pairs)
    pairs = similar(vectors, vectors, least_sim, above=True)
    named = pairs.join(typed.withColumnRenamed("entry_type", "ta"), "id").join(typed.select(F.col("id").alias("other"), F.col("entry_type").alias("tb")), "other")
    named = named.withColumns({"t1": F.least("ta", "tb"), "t2": F.greatest("ta", "tb")}).join(base, ["t1", "t2"])
    named = named.join(linked_pairs(links), (F.least("id", "other") == F.col("a")) & (F.greatest("id", "other") == F.col("b")), "left")
    surprise = F.when(F.col("baseline") <= 0, 0.0).otherwise(F.col("cosine") / F.col("baseline"))
    out = named.withColumn("surprise", surprise).withColumn("linked", F.coalesce("linked", F.lit(False))).filter(F.col("surprise") >= least_surprise)
    if not include_linked:
        out = out.filter(~F.col("linked"))
    out = out.orderBy(F.desc("surprise"), F.desc("cosine"), "id", "other").limit(most)
    return out.select("id", "other", "t1", "t2", F.round("cosine", 4).alias("similarity"), F.round("baseline", 4).alias("baseline"), F.round("surprise", 4).alias("surprise"), "linked")


def type_pair_baselines(typed: DataFrame, vectors: DataFrame, least_pairs: int = 5) -> DataFrame:
    """(t1, t2, n_pairs, baseline): mean cosine of a type pair's unordered entry pairs, without forming them.

    The sum over pairs of two types is the product of the types' vector sums; within a type it is half of the squared
    sum less the squared lengths.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.join(typed, "id").select("entry_type", F.when(norm > 0, F.transform("vec", lambda x: x.cast("double") / norm)).otherwise(F.transform("vec", lambda x: x.cast("double"))).alias("u"))
    sums = unit.select("entry_type", F.posexplode("u").alias("pos", "x")).groupBy("entry_type", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    left = sums.select(F.col("entry_type").alias("t1"), "pos", F.col("s").alias("s1"), "q", F.col("n").alias("n1"))
    right = sums.select(F.col("entry_type").alias("t2"), "pos", F.col("s").alias("s2"), F.col("n").alias("n2"))
    both = left.join(right, "pos").filter("t1 <= t2").groupBy("t1", "t2").agg(F.sum(F.col("s1") * F.col("s2")).alias("dot"), F.sum("q").alias("q"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    same = F.col("t1") == F.col("t2")
    pairs = both.select("t1", "t2", F.when(same, (F.col("dot") - F.col("q")) / 2).otherwise(F.col("dot")).alias("total"), F.when(same, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).cast("long").alias("n_pairs"))
    every = F.sum("total").over(Window.partitionBy()) / F.sum("n_pairs").over(Window.partitionBy())
    return pairs.select("t1", "t2", "n_pairs", F.when(F.col("n_pairs") >= least_pairs, F.col("total") / F.col("n_pairs")).otherwise(every).alias("baseline"))


def pair_distribution(pairs: DataFrame) -> DataFrame:
    """Of surprising pairs, by type pair: count, largest surprise, mean similarity."""
    return pairs.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.max("surprise").alias("max_surprise"), F.round(F.avg("similarity"), 4).alias("mean_similarity"))


def link_candidates(vectors: DataFrame, links: DataFrame, least: float = 0.78, most: int = 100, entries: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """(id, other, similarity): unlinked pairs, most alike first; optionally only of entries of some types."""
    if types and entries is not None:
        vectors = vectors.join(entries.filter(F.col("entry_type").isin(*types)).select("id"), "id", "left_semi")
    pairs = similar(vectors, vectors, least, above=True)
    known = linked_pairs(links)
    free = pairs.join(known, (F.least("id", "other") == F.col("a")) & (F.greatest("id", "other") == F.col("b")), "left_anti")
    return free.orderBy(F.desc("cosine"), "id", "other").limit(most).select("id", "other", F.round("cosine", 4).alias("similarity"))


def outliers(rows: DataFrame, distance: str, deviations: float = 2.0) -> DataFrame:
    """Rows whose distance is over mean + 2 population deviations, with the z-score (one pass for the two moments)."""
    m = rows.agg(F.avg(distance).alias("m"), F.stddev_pop(distance).alias("s")).first()
    if m["m"] is None:
        return rows.withColumn("z", F.lit(None).cast("double")).limit(0)
    z = (F.col(distance) - m["m"]) / m["s"] if m["s"] else F.lit(0.0)
    return rows.withColumn("z", z).filter(F.col(distance) > m["m"] + deviations * m["s"])


def validate_claim(claim: DataFrame, kb: DataFrame, links: DataFrame, top_k: int = 15, high: float = 0.72, low: float = 0.55) -> DataFrame:
    """Per claim (id, vec): supporting, related and contradicting entries, and score = clamp((S - C/2) / max(1, S + C + R)).

    Entries of similarity >= high support, of >= low are related; both ends of a `tensions with` link contradict if
    both are >= high.
    """
    near = similar(claim, kb, low, top_k).withColumn("bucket", F.when(F.col("cosine") >= high, "support").otherwise("related"))
    tense = links.filter(F.col("link_type") == "tensions with").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    strong = near.filter("bucket = 'support'")
    one = strong.select("id", F.col("other").alias("a")).join(tense, "a").join(strong.select("id", F.col("other").alias("b")), ["id", "b"])
    bad = one.select("id", F.explode(F.array("a", "b")).alias("other")).distinct().withColumn("bad", F.lit(True))
    j = near.join(bad, ["id", "other"], "left")
    c, s, r = F.count_if("bad"), F.count_if((F.col("bucket") == "support") & F.col("bad").isNull()), F.count_if(F.col("bucket") == "related")
    out = j.groupBy("id").agg(s.alias("n_support"), c.alias("n_contradict"), r.alias("n_related"), F.max("cosine").alias("best"))
    score = (F.col("n_support") - 0.5 * F.col("n_contradict")) / F.greatest(F.lit(1), F.col("n_support") + F.col("n_contradict") + F.col("n_related"))
    return claim.select("id").join(out, "id", "left").fillna(0, ["n_support", "n_contradict", "n_related"]).withColumn("score", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.0)))


def resolve_claims(claims: DataFrame, chunks: DataFrame, top_k: int = 10, min_sim: float = 0.65) -> DataFrame:
    """(id, entry_id, similarity, channel, polarity, note): best chunk an entry, of 3 x top_k nearest, at least min_sim."""
    best = best_chunks(chunks, claims, 3 * top_k, "cosine").filter(F.col("similarity") >= min_sim)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "entry_id"))
    out = best.withColumn("r", rank).filter(F.col("r") <= top_k).drop("r").withColumn("channel", channel_tier(F.col("similarity")))
    extra = [c for c in ("polarity", "human_approved") if c in claims.columns]
    out = out.join(claims.select("id", *extra), "id")
    if "human_approved" in extra:
        out = out.withColumn("note", F.when(~F.col("human_approved"), "claim awaits human approval"))
    return out
