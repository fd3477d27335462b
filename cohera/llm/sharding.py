"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each input partition go to each cell of each shard follows the multivariate hypergeometric law of a
uniform random permutation. The matrix is drawn as a tree over the partitions: a node splits what its columns hold
between its two halves, by draws of its own seed, so a task finds its own row by walking from the root to its leaf
and nobody holds the whole matrix. Each partition permutes its rows locally and deals them out by its row, rows are
exchanged by cell, and each cell permutes what it got. Shard sizes are exact (at most one apart) and every
arrangement is equally likely. A shard is cut into cells so that no task ever holds a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohera.plans.shared import cut

#: Rows aimed at in a cell, and the most cells (a row of the matrix has one number for each).
CELL_ROWS, MOST_CELLS = 50_000, 65_536
#: numpy draws from populations below this size.
NUMPY_LIMIT = 1_000_000_000


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most; the first shards are the larger ones."""
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where x is near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v * v * v, 3
        while True:
            more = total + term / j
            if more == total:
                return total
            total, term, j = more, term * v * v, j + 2
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability, by deviances (exact to rounding at any size)."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    errors = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return errors - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def draw_large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw at any size: rejection under the hat that fits every log-concave law on the integers."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p = n / total
    log = lambda k: _log_binomial(k, good, p) + _log_binomial(n - k, bad, p)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    at_mode = log(mode)
    peak = math.exp(at_mode - _log_binomial(n, total, p))
    w = 1 + peak / 2
    while True:
        u, v, accept = rng.random(3)
        y = v * w / peak if u <= w / (1 + w) else (w - math.log1p(-v)) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and accept * min(1.0, math.exp(w - peak * y)) <= math.exp(log(k) - at_mode):
            return k


def draw_split(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of `n` rows drawn from the columns fall in each column (multivariate hypergeometric)."""
    total = int(columns.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, n, method="marginals") if len(columns) else columns.copy()
    if len(columns) == 1:
        return np.array([n], np.int64)
    half = len(columns) // 2
    good = int(columns[:half].sum())
    k = draw_large(rng, good, total - good, n)
    return np.concatenate([draw_split(rng, columns[:half], k), draw_split(rng, columns[half:], n - k)])


def matrix_row(ends: np.ndarray, columns: np.ndarray, seed: int, p: int) -> np.ndarray:
    """Row p of the communication matrix; partition p has ends[p + 1] - ends[p] rows."""
    lo, hi, left = 0, len(ends) - 1, columns
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = draw_split(np.random.default_rng([seed, 0, lo, hi]), left, int(ends[mid] - ends[lo]))
        if p < mid:
            left, hi = first, mid
        else:
            left, lo = left - first, mid
    return left


def shuffle_to_shards(df: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """`df` with shard (0 to shards - 1) and slot (0, 1, ... without gaps within a shard).

    Every row counts, repeated ones too, whatever its values; nulls play no part. An empty table gives an empty one,
    and shards can be empty where there are fewer rows than shards. Columns named shard or slot are replaced. The
    rows are first written to the shared folder, so that partitions hold the same rows when a lost executor's work
    is redone; draws depend on the seed and on these partitions alone. The driver gets one count a partition; tasks
    get these and the sizes of at most MOST_CELLS cells (or one cell a shard, with more shards).
    """
    rows = df.drop("shard", "slot")
    kept = cut(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")))
    counts = {r["p"]: r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, parts = sum(counts.values()), max(counts, default=-1) + 1
    sizes = shard_sizes(n, shards)
    per_shard = int(max(1, min(-(-n // (shards * CELL_ROWS)), MOST_CELLS // shards)))
    cells = np.concatenate([shard_sizes(int(s), per_shard) for s in sizes])
    ends = np.cumsum([0, *(counts.get(p, 0) for p in range(parts))])
    starts = np.concatenate([np.cumsum(c) - c for c in cells.reshape(shards, per_shard)])
    shared = df.sparkSession.sparkContext.broadcast((ends, cells, starts))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_cell", "_first", "_key", "_at"))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        ends, cells, starts = shared.value
        rng = np.random.default_rng([seed, 1, own])
        if own >= len(ends) - 1:
            return
        labels = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(ends, cells, seed, own))
        rng.shuffle(labels)
        done = 0
        for batch in batches:
            cell = labels[done : done + batch.num_rows].astype(np.int64)
            keys = rng.integers(-(2**63), 2**63 - 1, batch.num_rows, np.int64)
            at = np.arange(done, done + batch.num_rows, dtype=np.int64) + (own << 40)
            done += batch.num_rows
            made = [pa.array(x) for x in (cell, starts[cell], keys, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    again = Window.partitionBy("_cell").orderBy("_key", "_at")
    out = kept.mapInArrow(deal, schema).withColumn("slot", F.row_number().over(again).cast("long") - 1 + F.col("_first"))
    return out.select("row.*", F.expr(f"CAST(_cell DIV {per_shard} AS INT)").alias("shard"), "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_to_shards(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
