"""Weighted graphs: edges, distances, kernels, distributions and scores as long DataFrames."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.plans.shared import cut

EPS, MAX_SCORE = 1e-10, 20.0
#: Edges that may be broadcast to each worker for shortest paths (about 100 bytes each there).
MOST_BROADCAST_EDGES = 500_000


def tier_weight(tier: Column) -> Column:
    """Tier '1', '1.5', '2' as a weight; null and anything else weigh 3."""
    t = tier.cast("string")
    return F.when(t == "1", 1.0).when(t == "1.5", 1.5).when(t == "2", 2.0).otherwise(3.0)


def build_graph(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected edges (a <= b, weight): the least weight of parallel links; links to unknown vertices are dropped."""
    ids = vertices.select(F.col("id"))
    known = links.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")
    return merge_parallel(known.select("source_id", "target_id", tier_weight(F.col("confidence_tier")).alias("weight")))


def merge_parallel(links: DataFrame) -> DataFrame:
    ends = (F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return links.groupBy(*ends).agg(F.min("weight").alias("weight"))


def bridge_graph(bundle: DataFrame, bundle_links: DataFrame, wiki: DataFrame, wiki_links: DataFrame, bridges: DataFrame, min_sim: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of both universes with prefixed ids; edge type rrp, wiki or bridge (weight 1 - similarity)."""
    at = lambda p, c: F.concat(F.lit(p), F.col(c))
    vertices = bundle.select(at("rrp::", "id").alias("id"), "title").unionByName(wiki.select(at("wiki::", "id").alias("id"), "title"))

    def own(links: DataFrame, prefix: str, kind: str) -> DataFrame:
        return links.select(at(prefix, "source_id").alias("source_id"), at(prefix, "target_id").alias("target_id"), tier_weight(F.col("confidence_tier")).alias("weight"), F.lit(kind).alias("type"))

    near = bridges.filter(F.col("similarity") >= min_sim)
    crossing = near.select(at("rrp::", "rrp_entry_id").alias("source_id"), at("wiki::", "ds_entry_id").alias("target_id"), (1 - F.col("similarity")).alias("weight"), F.lit("bridge").alias("type"))
    every = own(bundle_links, "rrp::", "rrp").unionByName(own(wiki_links, "wiki::", "wiki")).unionByName(crossing)
    ids = vertices.select("id")
    every = every.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")
    ends = (F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return vertices, every.groupBy(*ends).agg(F.min("weight").alias("weight"), F.min_by("type", "weight").alias("type"))


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, weight) in both directions; a self-loop once."""
    out = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    if directed:
        return out
    return out.unionByName(edges.filter("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, isolated) of every vertex."""
    deg = adjacency(edges.withColumn("weight", F.lit(1.0)) if "weight" not in edges.columns else edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out = vertices.select("id").join(deg, F.col("id") == F.col("src"), "left")
    n = F.coalesce("degree", F.lit(0)).cast("long")
    return out.select("id", n.alias("degree"), (n == 0).alias("isolated"))


def relax_distances(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, d) shortest distances from `sources` (id), by min-plus joins until nothing changes.

    There are as many rounds as the longest of the shortest paths has edges. Each joins the pairs that changed with the adjacency, and is cut off in the shared folder; one count a
    round reaches the driver. Pairs that can't be reached are absent. Weights must not be negative.
    """
    steps = cut(adjacency(edges, directed).select(F.col("src").alias("via"), F.col("dst").alias("to"), "weight"))
    best = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d")))
    changed = best
    while True:
        tried = changed.join(steps, F.col("dst") == F.col("via")).groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("d") + F.col("weight")).alias("nd"))
        merged = cut(best.join(tried, ["src", "dst"], "full_outer").select("src", "dst", F.least("d", "nd").alias("nd"), "d"))
        better = F.col("d").isNull() | (F.col("nd") < F.col("d"))
        best = merged.select("src", "dst", F.col("nd").alias("d"))
        changed = merged.filter(better).select("src", "dst", F.col("nd").alias("d"))
        if changed.isEmpty():
            return best


def hop_distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(src, dst, d bigint) in hops, up to `most`: a frontier join a hop, new pairs only."""
    steps = cut(adjacency(edges.withColumn("weight", F.lit(1.0))).select(F.col("src").alias("via"), F.col("dst").alias("to")).distinct())
    seen = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("d"))
    frontier = seen
    for hop in range(1, most + 1):
        tried = frontier.join(steps, F.col("dst") == F.col("via")).select("src", F.col("to").alias("dst")).distinct()
        frontier = cut(tried.join(seen, ["src", "dst"], "left_anti").withColumn("d", F.lit(hop).cast("long")))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def distances(vertices: DataFrame, edges: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    """(src, dst, d) between all vertices: a heap search a source where the edge list is small, else relaxation."""
    rows = adjacency(edges, directed).limit(2 * MOST_BROADCAST_EDGES + 1).toArrow()
    if rows.num_rows > 2 * MOST_BROADCAST_EDGES:
        return relax_distances(edges if weighted else edges.withColumn("weight", F.lit(1.0)), vertices, directed)
    near: dict = defaultdict(list)
    for r in rows.to_pylist():
        near[r["src"]].append((r["dst"], r["weight"] if weighted else 1.0))
    shared = vertices.sparkSession.sparkContext.broadcast(dict(near))
    kind = vertices.schema["id"].dataType.simpleString()
    return vertices.select("id").mapInArrow(_searched(shared), f"src {kind}, dst {kind}, d double")


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            for source in batch.column(0).to_pylist():
                best, heap = {source: 0.0}, [(0.0, source)]
                done = set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    for to, w in near.get(v, ()):
                        if d + w < best.get(to, float("inf")):
                            best[to] = d + w
                            heapq.heappush(heap, (d + w, to))
                kind = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(best), kind), pa.array(list(best), kind), pa.array(list(best.values()), pa.float64())], ["src", "dst", "d"])

    return run


def exponential_kernel(d: Column, alpha: float = 1.0) -> Column:
    return F.exp(-alpha * d)


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two array columns as double; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm > 0, dot(u, v) / norm).otherwise(0.0)


def correlation_kernel(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """`pairs` with k = max(0, cosine of the two vectors)."""
    return pairs.withColumn("k", F.greatest(F.lit(0.0), cosine(F.col(u), F.col(v))))


def weighted_hop_kernel(pairs: DataFrame, u: str, v: str, d: str = "d", alpha: float = 1.0) -> DataFrame:
    """`pairs` with k = correlation x exponential; 0 where the distance is missing."""
    out = correlation_kernel(pairs, u, v)
    return out.withColumn("k", F.col("k") * F.coalesce(exponential_kernel(F.col(d), alpha), F.lit(0.0)))


def distribution(kernel: DataFrame, n_vertices: int) -> DataFrame:
    """(src, dst, p): kernel values k over all vertices; absent ones are 0, and a source of no weight is uniform.

    Only present pairs are returned, so a uniform source must have all of its pairs present.
    """
    total = kernel.groupBy("src").agg(F.sum("k").alias("total"))
    return kernel.join(total, "src").select("src", "dst", F.when(F.col("total") < EPS, 1.0 / max(n_vertices, 1)).otherwise(F.col("k") / F.col("total")).alias("p"))


def score_vectors(vertices: DataFrame, edges: DataFrame, dist: DataFrame, min_degree: int = 2) -> DataFrame:
    """(center, nb, u, p, s): log p_nb(u) - log p_center(u), clamped to +-20 where one of them is 0.

    Of centers with at least `min_degree` neighbours, over every vertex u that the center or the neighbour reaches.
    """
    nbs = adjacency(edges).select(F.col("src").alias("center"), F.col("dst").alias("nb")).distinct()
    able = nbs.groupBy("center").count().filter(F.col("count") >= min_degree).select("center")
    nbs = nbs.join(able, "center", "left_semi")
    pc = nbs.join(dist.select(F.col("src").alias("center"), F.col("dst").alias("u"), F.col("p").alias("pc")), "center")
    pn = nbs.join(dist.select(F.col("src").alias("nb"), F.col("dst").alias("u"), F.col("p").alias("pn")), "nb")
    both = pc.join(pn, ["center", "nb", "u"], "full_outer").fillna(0.0, ["pc", "pn"])
    none_c, none_n = F.col("pc") < EPS, F.col("pn") < EPS
    s = F.when(none_c & none_n, 0.0).when(none_c, MAX_SCORE).when(none_n, -MAX_SCORE).otherwise(F.log("pn") - F.log("pc"))
    return both.select("center", "nb", "u", F.col("pc").alias("p"), s.alias("s"))


def fim_matrix(scores: DataFrame) -> DataFrame:
    """(center, i, j, f): sum over u of s_i s_j p, for i <= j."""
    left = scores.select("center", "u", F.col("nb").alias("i"), F.col("s").alias("si"), "p")
    right = scores.select("center", "u", F.col("nb").alias("j"), F.col("s").alias("sj"))
    return left.join(right, ["center", "u"]).filter("i <= j").groupBy("center", "i", "j").agg(F.sum(F.col("si") * F.col("sj") * F.col("p")).alias("f"))


def participation_ratio(fim: DataFrame) -> DataFrame:
    """(center, pr) as trace^2 / squared norm, which needs no decomposition."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("f")).otherwise(0.0))
    norm = F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("f") * F.col("f"))
    return fim.groupBy("center").agg((trace * trace / norm).alias("pr"))
