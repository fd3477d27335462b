"""Variable-capacity best-fit packing of token sequences.

Only how many pieces there are of each length decides the packing, so it is worked out on that histogram (at most one
row for each length up to the largest capacity): lengths in falling order go to the open bins with the least room
that still fits, many bins at a step. Where none fits, every permitted capacity is filled on trial from the lengths
still to come, and the one of least cost per token it would really hold is opened, as often as that filling lasts;
in the end each bin shrinks to the smallest permitted capacity that holds its contents. This is done for several sets
of capacities, each alone included, and the plan of least total cost is taken. Documents then take the places of
their length in order of their rank, which is found by partition, without ever gathering a length in one task.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohera.llm.memory import lean
from cohera.plans.shared import cut

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence costs its start-up, its tokens, and attention that grows with its square.
START_COST, ATTENTION = 64.0, 32_768.0


def sequence_cost(capacity: int) -> float:
    return START_COST + capacity + capacity * capacity / ATTENTION


class Plan:
    """Where pieces go: places by (length, rank), and the capacity of bins by number."""

    def __init__(self, places: list[tuple[int, int, int, int, int]], bins: list[tuple[int, int]], cost: float = 0.0, n_bins: int = 0):
        self.cost, self.n_bins = cost, n_bins
        places = sorted(places)
        #: length, first rank, first bin, pieces a bin, offset in the bin
        self.places = np.array(places, np.int64).reshape(-1, 5)
        self.keys = (self.places[:, 0] << np.int64(44)) + self.places[:, 1]
        bins = sorted(bins)
        self.first = np.array([b[0] for b in bins], np.int64)
        self.capacity = np.array([b[1] for b in bins], np.int64)

    def assign(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset, capacity) of the pieces of these lengths and ranks."""
        row = np.searchsorted(self.keys, (length << np.int64(44)) + rank, side="right") - 1
        _, first_rank, first_bin, each, offset = self.places[row].T
        r = rank - first_rank
        at = first_bin + r // each
        return at, offset + (r % each) * length, self.capacity[np.searchsorted(self.first, at, side="right") - 1]


class _Trial:
    """The pieces still to come by length, less those that bins opened before were opened for."""

    def __init__(self, histogram: dict[int, int]):
        self.lengths = sorted(k for k, n in histogram.items() if n > 0)
        self.left = dict(histogram)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] <= 0:
            at = bisect_left(self.lengths, length)
            if at < len(self.lengths) and self.lengths[at] == length:
                self.lengths.pop(at)

    def filling(self, length: int, n: int, capacity: int) -> tuple[dict[int, int], int]:
        """What a bin opened for `length` would take, in falling order of lengths, and how many bins that lasts for."""
        each = min(capacity // length, n)
        took, room, times = {length: each}, capacity - each * length, n // each
        at = bisect_left(self.lengths, length) - 1
        while room and at >= 0:
            at = min(at, bisect_left(self.lengths, room + 1) - 1)
            if at < 0:
                break
            k = self.lengths[at]
            each = min(room // k, self.left[k])
            took[k], room, times = each, room - each * k, min(times, self.left[k] // each)
            at -= 1
        return took, times


def plan_bins(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """The least costly of several packings of a histogram of lengths (1 to the largest capacity): over all capacities,
    over the largest ones (for every number of them), and over each alone that holds the longest piece."""
    sizes, longest = sorted(set(capacities)), max(histogram, default=0)
    sets = {tuple(sizes[i:]) for i in range(len(sizes))} | {(c,) for c in sizes}
    plans = [_fill(histogram, s, sizes, cost) for s in sorted(sets, key=lambda s: (-len(s), s)) if s[-1] >= longest]
    return min(plans, key=lambda plan: plan.cost)


def _fill(histogram: dict[int, int], opened: Sequence[int], sizes: Sequence[int], cost: Callable[[int], float], choices: int = 8) -> Plan:
    """Best-fit decreasing with bins of the capacities `opened`, shrunk to `sizes` in the end.

    For each length the capacity is chosen anew after every filling that lasts no longer, and at most about `choices`
    times.
    """
    trial = _Trial(histogram)
    open_: dict[int, list[list[int]]] = {}  # room -> ranges of bins [first, count, capacity]
    rooms: list[int] = []
    places: list[tuple[int, int, int, int, int]] = []
    full: list[tuple[int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int, capacity: int) -> None:
        if not count:
            return
        if room == 0:
            full.append((first, count, capacity))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([first, count, capacity])

    def shrunk(held: int) -> int:
        return sizes[bisect_left(sizes, held)]

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        least = -(-n // choices)
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                tried = []
                for c in opened:
                    if c >= length:
                        took, times = trial.filling(length, n, c)
                        held = sum(k * m for k, m in took.items())
                        tried.append((cost(shrunk(held)) / held, c, took, times))
                _, best, took, times = min(tried, key=lambda x: x[:2])
                count = max(1, min(max(times, -(-least // took[length])), -(-n // took[length])))
                for k, m in took.items():
                    if k != length:
                        trial.take(k, m * count)
                put(best, bins, count, best)
                bins += count
                continue
            room = rooms[at]
            first, count, capacity = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            whole = min(count, n // each)
            offset = capacity - room
            if whole:
                places.append((length, rank, first, each, offset))
                put(room - each * length, first, whole, capacity)
                rank, n = rank + whole * each, n - whole * each
            if whole < count and n and n < each:
                places.append((length, rank, first + whole, each, offset))
                put(room - n * length, first + whole, 1, capacity)
                rank, n, whole = rank + n, 0, whole + 1
            put(room, first + whole, count - whole, capacity)
        trial.take(length, trial.left[length])
    ends, total = [], 0.0
    for room, ranges in [(0, full), *open_.items()]:
        for first, count, capacity in ranges:
            ends.append((first, shrunk(capacity - room)))
            total += count * cost(ends[-1][1])
    return Plan(places, ends, total, bins)


@cache
def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """`docs` with the token count of every whole text (null: 0), special strings taken as ordinary text."""
    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = docs.drop(*({out_col} - {text_col}))
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(where).encode_ordinary
        for batch in batches:
            counts = [len(encode((t.as_py() or b"").decode("utf-8", "replace"))) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], schema.names)

    return kept.mapInArrow(lean(run), schema)


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """Pieces of documents in bins: id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. One of no tokens (or
    a null count) is one piece of 0 tokens in no bin (nulls). Repeated rows are packed each; ids may be null; other
    columns are ignored; an empty table gives an empty one. Rows are cut off first, so that ranks stay when work is
    redone. The driver gets the histogram, of at most as many rows as the largest capacity.
    """
    largest = max(capacities)
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"))
    count = F.greatest(F.ceil(F.col("n") / largest), F.lit(1)).cast("long")
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = cut(pieces.select("id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(largest + 1, np.int64)
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(n, kind="stable")
            ordered = n[order]
            first = np.r_[True, ordered[1:] != ordered[:-1]] if len(n) else np.empty(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
            local = np.empty(len(n), np.int64)
            local[order] = np.arange(len(n)) - begin + seen[ordered]
            seen += np.bincount(n, minlength=largest + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part)), pa.array(local)], ["id", "piece", "start", "n", "part", "local"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("part", T.LongType()), T.StructField("local", T.LongType())])
    counts = cut(pieces.filter("n > 0").groupBy(F.spark_partition_id().cast("long").alias("part"), "n").agg(F.count(F.lit(1)).alias("k")))
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("part", "n", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip")))
    histogram = {r["n"]: r["k"] for r in counts.groupBy("n").agg(F.sum("k").alias("k")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_bins(histogram, capacities, cost))
    ranked = pieces.mapInArrow(lean(rank), schema).join(offsets, ["part", "n"], "left")
    ranked = ranked.select("id", "piece", "start", "n", (F.col("local") + F.col("skip")).alias("rank"))
    made = [("bin_id", T.LongType()), ("bin_capacity", T.IntegerType()), ("bin_offset", T.IntegerType())]
    final = T.StructType([*ranked.schema.fields[:4], *[T.StructField(c, t) for c, t in made]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            none = n == 0
            rank = np.where(none, 0, np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False))).astype(np.int64)
            if len(plan.value.places):
                bins, offset, capacity = plan.value.assign(np.where(none, plan.value.places[0, 0], n), rank)
            else:
                bins = offset = capacity = np.zeros(len(n), np.int64)
            out = [pa.array(x, t, mask=none) for x, t in ((bins, pa.int64()), (capacity.astype(np.int32), pa.int32()), (offset.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *out], final.names)

    return ranked.mapInArrow(lean(assign), final).withColumnsRenamed({"id": id_col, "n": "n_tokens"})


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(with_lengths(docs).select("doc_id", "n_tokens"))
