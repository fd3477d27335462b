"""SimHash near-duplicates: 64-bit fingerprints, linked by a binary-trie self-join, grouped into components.

A fingerprint holds, bit by bit, the majority of the XXH64 (seed 42) hashes of a text's word shingles. The 64 bits are
cut into `budget + r` blocks; two fingerprints that differ in at most `budget` bits agree in r of them at least, so
each is dealt once for every choice of r blocks, and every link is found in a bucket. r grows with the number of
fingerprints, so that buckets stay small; the links are the same for any r. Within a bucket the fingerprints form a
binary trie which is joined with itself: node pairs descend together, differing bits are added up, and a pair is
dropped once they exceed the budget. A bucket returns a spanning forest of its links, never all of its pairs.

With `wide_words`, a link must also hold between 512-bit fingerprints of distinct shingles of so many words: those of
two texts of cosine c differ in acos(c) / pi of their bits, and c is 2 s / (1 + s) for a Jaccard similarity of s and
texts of one length. The similarity so estimated has a standard error of about 0.025 near 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohera.llm.memory import lean
from cohera.operators.components import connected_components
from cohera.plans.shared import cut, salted_lookup, written

SEED = 42
#: Lanes of 64 bits in a wide fingerprint; further lanes are mixed from a shingle's one hash.
LANES = 8
#: Rows of whole buckets that one trie is built over, and node pairs held at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 50_000, 100_000
#: Trie nodes that a node of a crowded bucket may meet, itself included. Only fingerprints that are nearly all alike stay crowded.
MOST_PARTNERS = 1_024
#: Mean rows of a bucket up to which fewer, larger buckets are chosen: comparisons grow with its square, dealt rows with r.
MEAN_BUCKET = 256


def _shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) <= k:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def _majority(raw: np.ndarray) -> bytes:
    """Bits that are set in over half of the rows (bytes)."""
    ones = np.zeros(raw.shape[1] * 8, np.int64)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(raw)).tobytes()


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, SEED) for s in _shingles(words, shingle_words)])
    return int.from_bytes(_majority(np.frombuffer(raw, np.uint8).reshape(-1, 8)), "big", signed=True)


def wide_fingerprint(text: bytes, shingle_words: int = 5) -> bytes:
    """The fingerprint of LANES x 64 bits, each distinct shingle counted once; all zeros if the text has no word."""
    words = text.lower().split()
    if not words:
        return bytes(8 * LANES)
    digest = xxhash.xxh64_intdigest
    shingles = set(_shingles(words, shingle_words))
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    lanes = [h]
    for _ in range(LANES - 1):  # splitmix steps
        h = lanes[-1] + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        lanes.append((h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB))
    return _majority(np.ascontiguousarray(np.stack(lanes, axis=1)).view(np.uint8).reshape(len(h), -1))


def wide_budget(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of this Jaccard similarity differ."""
    return int(64 * LANES * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, wide_words: int | None = None) -> DataFrame:
    """(id, fp bigint, wide binary) of every row; a null text counts as one without words. wide is null without `wide_words`."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, wide = [], []
            for t in batch.column(1).cast(pa.binary()):
                text = t.as_py() or b""
                fps.append(fingerprint(text, shingle_words))
                wide.append(wide_fingerprint(text, wide_words) if wide_words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(wide, pa.binary())], ["id", "fp", "wide"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType())])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(run), schema)


def trie_links(values: np.ndarray, bucket: np.ndarray, budget: int, side: np.ndarray | None = None, wide: np.ndarray | None = None, wide_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, root) that span the links among `values` (uint64, ascending within each ascending bucket).

    A bucket is joined with itself; one whose rows have sides 1 and 2 (ascending, values ascending within a side) only
    from side to side. `wide` (rows of uint64) must then differ in at most `wide_bits` bits. Nodes are ranges of the
    sorted array; a level splits each at its bit and pairs the halves. Pairs of single leaves are compared at once.
    At most PAIRS_AT_ONCE pairs are expanded together; the rest wait on a stack.
    """
    n = len(values)
    label = np.arange(n)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).astype(np.int32)
    ends = np.r_[edges[1:], np.int32(n)]
    if side is None or not side.any():
        many = ends - edges > 1
        al, ah = edges[many], ends[many]
        bl, bh = al, ah
    else:
        second = np.r_[0, np.cumsum(side == 2)].astype(np.int32)
        middle_of = ends - (second[ends] - second[edges])
        own = side[edges] == 0
        many = np.where(own, ends - edges > 1, (middle_of > edges) & (middle_of < ends))
        al, ah = edges[many], np.where(own, ends, middle_of)[many]
        bl, bh = np.where(own, edges, middle_of)[many], ends[many]
    stack = [(0, al, ah, bl, bh, np.zeros(len(al), np.int8))]
    before: dict[int, np.ndarray] = {}

    def middle(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in before:
            before[depth] = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)].astype(np.int32)
        return high - (before[depth][high] - before[depth][low])

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.ones(len(j), bool) if wide is None else np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= wide_bits

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if not len(al):
            continue
        if len(al) > PAIRS_AT_ONCE:
            half = len(al) // 2
            stack.append((depth, al[half:], ah[half:], bl[half:], bh[half:], err[half:]))
            stack.append((depth, al[:half], ah[:half], bl[:half], bh[:half], err[:half]))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i != j) & (label[i] != label[j]) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            i, j = i[near], j[near]
            near = alike(i, j)
            join(i[near], j[near])
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if depth == 64:
            # Equal fingerprints on either side; each of one side meets those of the other that aren't yet linked to it.
            for a, b, c, d in zip(al.tolist(), ah.tolist(), bl.tolist(), bh.tolist(), strict=True):
                for i in range(a, b):
                    j = np.arange(max(c, i + 1) if a == c else c, d)
                    j = j[label[j] != label[i]]
                    j = j[alike(np.full(len(j), i), j)]
                    join(np.full(len(j), i), j)
            continue
        if not len(al):
            continue
        am, bm, own = middle(depth, al, ah), middle(depth, bl, bh), al == bl
        parts = [
            (al, am, bl, bm, err, None),
            (am, ah, bm, bh, err, None),
            (al, am, bm, bh, err + 1, None),
            (am, ah, bl, bm, err + 1, ~own),
        ]
        kids = []
        for pal, pah, pbl, pbh, perr, keep in parts:
            ok = (pah > pal) & (pbh > pbl) & (perr <= budget)
            kids.append(tuple(x[ok if keep is None else ok & keep] for x in (pal, pah, pbl, pbh, perr)))
        stack.append((depth + 1, *(np.concatenate([k[c] for k in kids]) for c in range(5))))
    loose = np.flatnonzero(label != np.arange(n))
    return loose, label[loose]


def _bucket_links(budget: int, wide_bits: int | None):
    """Whole buckets, in order, are gathered up to ROWS_AT_ONCE rows and joined together."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys, side, fps, node = (rows.column(i).to_numpy() for i in range(4))
        values = fps.view(np.uint64)
        order = np.lexsort((values, side, keys))
        wide = None
        if wide_bits is not None:
            joined = b"".join(rows.column(4).to_pylist())
            wide = np.frombuffer(joined, np.uint64).reshape(len(keys), -1)[order]
        i, j = trie_links(values[order], keys[order], budget, side[order], wide, wide_bits or 0)
        node = node[order]
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                last = batch.column(0)[-1].as_py()
                if held[0].column(0)[0].as_py() != last:
                    rows = pa.Table.from_batches(held)
                    full = int(np.searchsorted(rows.column(0).to_numpy(), last))
                    yield links(rows.slice(0, full))
                    rows = rows.slice(full).combine_chunks()
                    held, size = rows.to_batches(), rows.num_rows
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def block_choices(n: int, budget: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(bounds of the blocks, choices of r blocks): the least r whose buckets have about MEAN_BUCKET of n rows."""
    for r in range(1, 5):
        blocks = budget + r
        if n >> (r * (64 // blocks)) <= MEAN_BUCKET:
            break
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(bounds[:-1], bounds[1:], strict=True)), list(combinations(range(blocks), r))


def dealt_buckets(distinct: DataFrame, budget: int = 3, most_in_bucket: int = 100_000) -> DataFrame:
    """(k, side, fp, node, wide): every fingerprint in the buckets where its links are found.

    A bucket of more than `most_in_bucket` rows is cut by trie nodes: bits outside its own blocks, as many as it
    takes until no node has more, or until a node has MOST_PARTNERS others within the budget. Each node is joined
    with itself, and (sides 1 and 2) with each of these; no row and no pair of nodes is left out.
    """
    blocks, choices = block_choices(distinct.count(), budget)
    mask = lambda choice: sum(((1 << (blocks[i][1] - blocks[i][0])) - 1) << blocks[i][0] for i in choice)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    entry = lambda c, choice: F.struct(F.lit(c).alias("c"), F.xxhash64(F.lit(c), F.col("fp").bitwiseAND(F.lit(signed(mask(choice))))).alias("k"))
    dealt = distinct.select("fp", "node", "wide", F.inline(F.array(*[entry(c, choice) for c, choice in enumerate(choices)])))
    sizes = cut(dealt.groupBy("k").count().filter(F.col("count") > most_in_bucket))
    whole = dealt.select("k", F.lit(0).cast("byte").alias("side"), "fp", "node", "wide")
    if sizes.isEmpty():
        return whole
    marked = salted_lookup(dealt, sizes, "k", "fp")
    hot = cut(marked.filter("count is not null").select("c", "k", "fp", "node", "wide"))
    free = [[b for b in range(64) if not mask(choice) >> b & 1] for choice in choices]
    bit = lambda b, at: F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), at)

    def node_at(depth: int):
        """The free bits of the row's choice, spread over all of them."""
        spread = lambda bits: sum((bit(bits[at * len(bits) // depth], at) for at in range(depth)), F.lit(0).cast("bigint"))
        return F.element_at(F.array(*[spread(bits) for bits in free]), F.col("c") + 1)

    deepest = max(d for d in range(1, min(map(len, free)) + 1) if sum(math.comb(d, e) for e in range(budget + 1)) <= MOST_PARTNERS)
    depth, most = 0, most_in_bucket + 1
    while most > most_in_bucket and depth < deepest:
        depth = min(deepest, depth + max(1, math.ceil(math.log2(most / most_in_bucket))))
        most = hot.groupBy("k", node_at(depth).alias("p")).count().agg(F.max("count")).first()[0]
    masks = [sum(1 << b for b in bits) for e in range(budget + 1) for bits in combinations(range(depth), e)]
    pairs = hot.withColumn("p", node_at(depth)).withColumn("m", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])))
    pairs = pairs.withColumn("q", F.col("p").bitwiseXOR(F.col("m")))
    side = F.when(F.col("m") == 0, 0).when(F.col("p") < F.col("q"), 1).otherwise(2).cast("byte")
    cold = marked.filter("count is null").select(*whole.columns[:1], F.lit(0).cast("byte").alias("side"), "fp", "node", "wide")
    return cold.unionByName(pairs.select(F.xxhash64("k", F.least("p", "q"), F.greatest("p", "q")).alias("k"), side.alias("side"), "fp", "node", "wide"))


def fingerprint_links(distinct: DataFrame, budget: int = 3, most_in_bucket: int = 100_000, wide_bits: int | None = None) -> DataFrame:
    """Links (u, v) that connect whatever nodes reach one another by steps of at most `budget` bits of fp.

    `distinct` has each fp once, and, with `wide_bits`, each (node, fp, wide) once: wide must then differ in at most
    so many bits as well. Without columns node and wide, an fp is its own node.
    """
    rows = distinct.select(
        "fp", F.col("node") if "node" in distinct.columns else F.col("fp").alias("node"),
        F.col("wide") if "wide" in distinct.columns else F.lit(None).cast("binary").alias("wide"),
    )
    tasks = dealt_buckets(rows, budget, most_in_bucket).repartition("k").sortWithinPartitions("k")
    return tasks.mapInArrow(lean(_bucket_links(budget, wide_bits)), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, budget: int = 3, wide_words: int | None = None, similarity: float = 0.8) -> DataFrame:
    """Per row of `docs`: the id, fp (bigint) and component_id, the smallest id that links reach.

    Whole texts, A-Z lower-cased. Texts without a word (empty, white space, null) have fingerprint 0 and are linked
    like any other. Equal fingerprints are linked; rows may repeat. With `wide_words` a link also takes wide
    fingerprints as near as those of texts of that Jaccard `similarity`. A null id gets a fingerprint and the smallest
    non-null id of its component (null if it has none). An empty table gives an empty result. Other columns are
    ignored. Fingerprints of one value meet by partial minima only; only counts reach the driver.
    """
    node = F.xxhash64("fp", "wide") if wide_words else F.col("fp")
    rows = written(fingerprints(docs, id_col, text_col, shingle_words, wide_words).select("id", "fp", "wide", node.alias("node")), "fingerprints")
    least = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("wide").alias("wide")))
    links = fingerprint_links(least.select("node", "fp", "wide"), budget, wide_bits=wide_budget(similarity) if wide_words else None)
    named = least.select("node", "least").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = cut(salted_lookup(named.select("node", "component"), best, "component", "node").select("node", "component_id"))
    return salted_lookup(rows.select("id", "fp", "node"), table, "node", "id").select(F.col("id").alias(id_col), "fp", "component_id")


def hex64(column: str):
    """A bigint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
