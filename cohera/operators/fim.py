"""Fisher-information spectra of graph nodes, and sweeps over whole graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.operators import graph
from cohera.operators.graph import EPS, MAX_SCORE
from cohera.operators.vectors import similar

SPECTRUM = "center string, d_eff int, participation_ratio double, disorder_index double, sv_profile array<double>, raw_sigmas array<double>"


def regime(eta: Column) -> Column:
    return F.when(eta < 0.35, "radial_dominated").when(eta < 0.65, "isotropic").otherwise("noise_dominated")


def decompose(f: np.ndarray) -> tuple[int, float, list[float], float, list[float]]:
    """(d_eff, participation ratio, profile, disorder, raw values) of the spectrum of a symmetric matrix."""
    raw = np.linalg.svd(f, compute_uv=False)
    top = raw[0] if len(raw) and raw[0] > EPS else 1.0
    kept = raw[raw > EPS * top]
    if len(kept) < 2:
        return 1, 1.0, [1.0], 0.0, raw.tolist()
    gap = int(np.argmax(kept[:-1] / (kept[1:] + EPS)))
    return gap + 1, float(kept.sum() ** 2 / (kept**2).sum()), (kept / kept[0]).tolist(), float(kept[gap + 1] / kept[gap]), raw.tolist()


def spectrum_of(center_k: np.ndarray, neighbour_k: np.ndarray) -> tuple:
    """Spectrum from kernel values over all vertices: of the center (n) and of its neighbours (k x n)."""

    def normed(x: np.ndarray) -> np.ndarray:
        total = x.sum(axis=-1, keepdims=True)
        return np.where(total < EPS, 1.0 / max(x.shape[-1], 1), x / np.where(total < EPS, 1.0, total))

    p, q = normed(center_k), normed(neighbour_k)
    has_p, has_q = p >= EPS, q >= EPS
    logs = np.log(np.where(has_q, q, 1.0)) - np.log(np.where(has_p, p, 1.0))
    s = np.where(has_p & has_q, logs, np.where(has_q, MAX_SCORE, np.where(has_p, -MAX_SCORE, 0.0)))
    return decompose((s * p) @ s.T)


def sweep(vertices: DataFrame, edges: DataFrame, kernel: str = "exponential", alpha: float = 1.0, embeddings: DataFrame | None = None, min_degree: int = 2, directed: bool = False, weighted: bool = True) -> DataFrame:
    """One row a vertex: d_eff, participation ratio, disorder, regime and spectra, or a reason why it was skipped.

    `kernel` is exponential, correlation or weighted_hop; the latter two need `embeddings` (id, vec). Each center's
    own and neighbours' kernel rows meet in one group (degree x reached vertices), and no row is made of pairs.
    """
    vertices = vertices.select(F.col("id").cast("string").alias("id")).distinct()
    n = vertices.count()
    nbs = graph.adjacency(edges, directed).select(F.col("src").alias("center"), F.col("dst").alias("nb")).distinct()
    deg = nbs.groupBy("center").agg(F.count(F.lit(1)).alias("k"))
    if directed:  # neighbours are successors; the degree that is tested counts both directions
        both = edges.select(F.explode(F.array("a", "b")).alias("center")).groupBy("center").agg(F.count(F.lit(1)).alias("deg"))
    else:
        both = deg.withColumnRenamed("k", "deg")
    base = vertices.join(deg, F.col("id") == deg["center"], "left").drop("center").join(both, F.col("id") == both["center"], "left").drop("center")
    base = base.fillna(0, ["k", "deg"])
    if kernel not in ("exponential", "correlation", "weighted_hop"):
        reason = F.lit(f"unknown kernel: {kernel}")
    elif kernel != "exponential" and embeddings is None:
        reason = F.lit(f"embeddings required for {kernel.upper()} kernel")
    else:
        reason = F.lit(None).cast("string")
    if reason is not None and kernel != "exponential" and embeddings is not None:
        have = embeddings.select(F.col("id").cast("string").alias("eid")).distinct()
        lacking = nbs.join(have, F.col("nb") == F.col("eid"), "left_anti").groupBy("center").agg(F.min("nb").alias("lack"))
        base = base.join(lacking, F.col("id") == F.col("center"), "left").drop("center")
        base = base.join(have.withColumn("own", F.lit(True)), F.col("id") == F.col("eid"), "left").drop("eid")
        reason = F.when(F.col("own").isNull(), F.concat(F.lit("no embedding for '"), "id", F.lit("'"))).when(
            F.col("lack").isNotNull(), F.concat(F.lit("no embedding for neighbor '"), "lack", F.lit("'"))
        )
    why = F.when(F.col("deg") < min_degree, F.concat(F.lit("degree="), F.col("deg"), F.lit(f" < min_degree={min_degree}"))).when(
        F.col("k") < 2, F.concat(F.lit("degree="), F.col("k"), F.lit(" < 2"))
    ).otherwise(reason)
    base = base.withColumn("skip_reason", why)
    able = base.filter("skip_reason is null").select(F.col("id").alias("center"))
    if kernel == "exponential":
        values = graph.distances(vertices, edges, directed, weighted).withColumn("kv", graph.exponential_kernel(F.col("d"), alpha))
    else:
        values = vertices.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("kv"))
        if embeddings is not None and kernel in ("correlation", "weighted_hop"):
            # Every center, and neighbour of one, against all embedded vertices (what the kernel is defined on), in blocks.
            e = embeddings.select(F.col("id").cast("string").alias("id"), "vec")
            asked = able.select("center").unionByName(nbs.join(able, "center", "left_semi").select(F.col("nb").alias("center"))).distinct()
            pairs = similar(e.join(asked, F.col("id") == F.col("center"), "left_semi"), e)
            values = pairs.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.greatest(F.lit(0.0), "cosine").alias("kv"))
            if kernel == "weighted_hop":
                d = graph.distances(vertices, edges, directed, weighted)
                hop = F.coalesce(graph.exponential_kernel(F.col("d"), alpha), F.lit(0.0))
                values = values.join(d, ["src", "dst"], "left").select("src", "dst", (F.col("kv") * hop).alias("kv"))
    rows = values.select("src", F.struct("dst", "kv").alias("x")).groupBy("src").agg(F.collect_list("x").alias("row"))
    roles = able.select("center", F.col("center").alias("src")).unionByName(nbs.join(able, "center", "left_semi").select("center", F.col("nb").alias("src")))
    roles = roles.withColumn("own", F.col("center") == F.col("src"))

    def analyze(pdf: pd.DataFrame) -> pd.DataFrame:
        index: dict = {}
        entries = []
        for row in pdf.row:
            entries.append([(index.setdefault(x["dst"], len(index)), x["kv"]) for x in (row if row is not None else [])])
        m = np.zeros((len(entries), n))
        for i, row in enumerate(entries):
            for j, k in row:
                m[i, j] = k
        own = pdf.own.to_numpy()
        center = int(np.flatnonzero(own)[0])
        loops = np.flatnonzero(own)[1:]  # a self-loop makes the center its own neighbour
        take = np.r_[np.flatnonzero(~own), loops].astype(int)
        d, pr, profile, eta, raw = spectrum_of(m[center], m[take])
        return pd.DataFrame({"center": [pdf.center.iloc[0]], "d_eff": [d], "participation_ratio": [pr], "disorder_index": [eta], "sv_profile": [profile], "raw_sigmas": [raw]})

    found = roles.join(rows, "src", "left").select("center", "own", "row").groupBy("center").applyInPandas(analyze, SPECTRUM)
    out = base.join(found, F.col("id") == F.col("center"), "left")
    skipped = F.col("skip_reason").isNotNull()
    return out.select(
        F.col("id").alias("entry_id"), F.lit(kernel).alias("kernel_type"), F.lit(alpha).alias("alpha"), "d_eff", "participation_ratio", "disorder_index",
        F.when(skipped, "degenerate").otherwise(regime(F.col("disorder_index"))).alias("regime"), "sv_profile", "raw_sigmas",
        F.when(F.col("deg") < min_degree, F.col("deg")).otherwise(F.col("k")).cast("int").alias("center_degree"), F.lit(n).alias("n_vertices"), skipped.alias("skipped"), "skip_reason",
    )


def analyze_node(vertices: DataFrame, edges: DataFrame, node: str, **options) -> DataFrame:
    """The sweep's row of one node; a node that isn't in the graph gets a row with that reason."""
    found = sweep(vertices, edges, **options).filter(F.col("entry_id") == node)
    one = vertices.sparkSession.range(1).select(F.lit(node).alias("entry_id"))
    out = one.join(found, "entry_id", "left")
    lost = F.col("skipped").isNull()
    return out.withColumns({"skip_reason": F.when(lost, F.concat(F.lit("node '"), "entry_id", F.lit("' not in graph"))).otherwise(F.col("skip_reason")), "regime": F.coalesce("regime", F.lit("degenerate")), "skipped": F.coalesce("skipped", F.lit(True))})


def sweep_summary(swept: DataFrame) -> DataFrame:
    """One row: analyzed and skipped nodes, mean d_eff, median disorder, nodes by regime."""
    ok = ~F.col("skipped")
    count = lambda r: F.count_if(F.col("regime") == r).alias(r)
    return swept.agg(
        F.count_if(ok).alias("n_analyzed"), F.count_if(~ok).alias("n_skipped"), F.avg(F.when(ok, F.col("d_eff"))).alias("mean_d_eff"),
        F.median(F.when(ok, F.col("disorder_index"))).alias("median_eta"), count("radial_dominated"), count("isotropic"), count("noise_dominated"), count("degenerate"),
    )


def top_hubs(swept: DataFrame, n: int = 10) -> DataFrame:
    return swept.filter(~F.col("skipped")).orderBy(F.desc("d_eff"), F.desc("participation_ratio"), "entry_id").limit(n)


def ordered_nodes(swept: DataFrame) -> DataFrame:
    return swept.filter(~F.col("skipped")).orderBy(F.desc("d_eff"), "disorder_index", "entry_id")
