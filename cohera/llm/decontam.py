"""Benchmark decontamination by a distributed positional inverted index of the training corpus.

The index is a stored table of postings (term, block, n, data): for each term and each block of whole documents the
delta-coded positions of the term in the block. It is written where the documents lie, block by block and sorted by
term in a block, so building it shuffles nothing, and a hot term's postings are split by ranges of documents. A block's
documents (place, first position, words) are its row for the empty term.

A search never holds the benchmark in one place. The windows of the items are rows; the postings of their terms are
taken out of the index once; terms are ranked by how often the whole corpus has them; a window is looked up by its
rarest term and kept for the blocks that have its next rarest as well. Per block the postings asked for then meet its
windows: the rarest term's positions, less the term's offset in
the window, are intersected with those of the next rarest, and so on. What is left are the exact phrase matches.
Proximity matches take the rarest term's postings and ask the other terms' for a position nearby in the same document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.llm.memory import lean
from cohera.plans.shared import placed, written

#: Words are runs of 0-9, a-z and every byte of a non-ASCII character; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Words of a block (a longer document is a block of its own).
BLOCK_WORDS = 1_000_000
PLACE = "struct<file: bigint, row: bigint>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


# ---- the index ---------------------------------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value) of non-negative numbers, seven bits a byte, lowest first; all but the last have bit 7."""
    values = values.astype(np.int64)
    sizes = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 6))
    out = np.zeros(int(sizes.sum()), np.uint8)
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[first[has] + k] = ((values[has] >> (7 * k)) & 127) | ((sizes[has] > k + 1) << 7)
    return out, sizes


def decode(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    first = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    sizes = ends - first + 1
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (data[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def postings(ids: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of each term, coded positions, bytes of each term): first position, then steps."""
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=n_terms)
    begins = np.cumsum(counts) - counts
    steps = np.diff(order, prepend=0)
    steps[begins] = order[begins]
    data, sizes = encode(steps)
    return counts, data, np.add.reduceat(sizes, begins) if n_terms else sizes


_INDEX = "term binary, block bigint, n bigint, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    terms, ids, docs, total = _Numbers(), [], [], 0

    def block() -> pa.RecordBatch:
        key = (part << 32) + number
        counts, data, sizes = postings(np.concatenate([np.empty(0, np.int32), *ids]), len(terms))
        starts = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes())
        coded = pa.Array.from_buffers(pa.binary(), len(terms), [None, starts, pa.py_buffer(data.tobytes())])
        places = pa.array([np.array(docs, np.int64).tobytes()], pa.binary())
        rows = pa.RecordBatch.from_arrays([
            pa.array([b"", *terms], pa.binary()), pa.array(np.full(len(terms) + 1, key)), pa.array(np.r_[len(docs), counts].astype(np.int64)), pa.concat_arrays([places, coded]),
        ], ["term", "block", "n", "data"])
        return rows.take(pc.sort_indices(rows.column(0)))

    for batch in batches:
        files, rows = (batch.column(0).field(k).to_pylist() for k in range(2))
        for file, row, text in zip(files, rows, batch.column(1).cast(pa.binary()), strict=True):
            own = words(text.as_py())
            docs.append((file, row, total, len(own)))
            ids.append(np.fromiter(map(terms.__getitem__, own), np.int32, len(own)))
            total += len(own)
            if total >= BLOCK_WORDS:
                yield block()
                number, terms, ids, docs, total = number + 1, _Numbers(), [], [], 0
    if docs:
        yield block()


def build_index(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored postings of `rows` (columns _at, as `placed` makes it, and the text): _INDEX, sorted by block and term.

    A null text is a document without words.
    """
    texts = rows.select("_at", F.col(f"`{text_col}`").cast("string").alias("text"))
    return written(texts.mapInArrow(lean(_blocks), _INDEX), "index")


def documents(index: DataFrame) -> DataFrame:
    """(_at, n_words) of every document in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                file, row, _, n = np.frombuffer(data, np.int64).reshape(-1, 4).T
                place = pa.StructArray.from_arrays([pa.array(file), pa.array(row)], ["file", "row"])
                yield pa.RecordBatch.from_arrays([place, pa.array(n)], ["_at", "n_words"])

    return index.filter(F.length("term") == 0).select("data").mapInArrow(lean(run), f"_at {PLACE}, n_words bigint")


# ---- the search --------------------------------------------------------------------------------------------------


def windows_of(bench: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, terms, item): the windows of each item; w is the SHA-256 of the terms. Rows may repeat.

    A window is `width` consecutive words; an item of fewer words, but not none, is one window. Items are named by
    their text form; a null item is the empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = words(text.as_py())
                n = max(1, len(own) - width + 1) if own else 0
                for lo in range(0, n, 10_000):
                    cuts = [own[i : i + width] for i in range(lo, min(n, lo + 10_000))]
                    ids = [hashlib.sha256(b" ".join(c)).digest() for c in cuts]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(cuts, pa.list_(pa.binary())), pa.array([item] * len(cuts), pa.string())], ["w", "terms", "item"])

    items = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return items.mapInArrow(lean(run), "w binary, terms array<binary>, item string")


def asked_postings(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The postings of the windows' terms, and the documents of every block. Stored."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    wanted = terms.unionByName(terms.sparkSession.range(1).select(F.lit(b"").alias("term")))
    return written(index.join(written(wanted, "terms"), "term", "left_semi"), "asked")


def ranked_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, terms): the distinct windows all of whose terms the corpus has, as (n, at, term) from the rarest to the commonest."""
    distinct = windows.groupBy("w").agg(F.first("terms").alias("terms"))
    each = distinct.select("w", F.posexplode("terms").alias("at", "term"))
    counts = index.groupBy("term").agg(F.sum("n").alias("n"))
    found = each.join(counts, "term").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("ranked"))
    return found.join(distinct, "w").filter(F.size("ranked") == F.size("terms")).select("w", F.col("ranked").alias("terms"))


def _term(k: int) -> Column:
    return F.col("terms")[k]["term"]


def candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(block, w, terms): windows by the blocks that have their rarest term, and their next rarest if it is another."""
    where = index.select("term", "block")
    first = ranked.withColumn("term", _term(0)).join(where, "term").drop("term")
    # The last of two equal terms in a window is no other term; then the rarest that differs from the first is asked for.
    other = F.element_at(F.filter(F.transform("terms", lambda t: t["term"]), lambda t: t != _term(0)), 1)
    first = first.withColumn("term", F.when(F.size(F.array_distinct(F.transform("terms", lambda t: t["term"]))) > 1, other).otherwise(_term(0)))
    return first.join(where, ["term", "block"], "left_semi").select("block", "w", "terms")


class Postings:
    """The positions of some terms in one block, and where its documents begin."""

    def __init__(self, terms: list[bytes], coded: list[bytes]):
        self.number = {t: i for i, t in enumerate(t for t in terms if t)}
        self.docs = np.frombuffer(coded[terms.index(b"")], np.int64).reshape(-1, 4)
        at = [np.cumsum(decode(np.frombuffer(c, np.uint8))) for t, c in zip(terms, coded, strict=True) if t]
        self.counts = np.array([len(a) for a in at], np.int64)
        self.at = np.concatenate([np.empty(0, np.int64), *at])
        self.starts = np.r_[0, np.cumsum(self.counts)]
        self.size = int(self.docs[-1, 2] + self.docs[-1, 3]) if len(self.docs) else 0
        self.keys = np.repeat(np.arange(len(at)), self.counts) * np.int64(self.size) + self.at

    def of(self, term: int) -> np.ndarray:
        return self.at[self.starts[term] : self.starts[term + 1]]

    def has(self, term: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether postings of term[i] hold where[i]."""
        wanted = term * np.int64(self.size) + where
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (where >= 0) & (where < self.size) & (self.keys[found] == wanted)

    def document(self, position: np.ndarray) -> np.ndarray:
        """The document of a position; empty documents have none."""
        return np.searchsorted(self.docs[:, 2], position, side="right") - 1


class Asked:
    """Windows as flat arrays of (offset, term number in the block or -1), each from its rarest term on."""

    def __init__(self, post: Postings, terms: pa.ListArray):
        flat = terms.flatten()
        self.sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.offset = pc.struct_field(flat, "at").to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(pc.struct_field(flat, "term"), value_set=pa.array(post.number, pa.binary()))
        self.term = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def phrase_matches(post: Postings, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, length) of every exact occurrence."""
    none = np.empty(0, np.int64)
    out = [(none, none, none)]
    for n in np.unique(asked.sizes).tolist():
        numbers = np.flatnonzero(asked.sizes == n)
        at = asked.first[numbers][:, None] + np.arange(n)
        offset, term = asked.offset[at], asked.term[at]
        alive = (term >= 0).all(axis=1)
        numbers, offset, term = numbers[alive], offset[alive], term[alive]
        lengths = post.counts[term[:, 0]]
        step = max(1, 1_000_000 // max(1, int(lengths.max(initial=1))))
        for a in range(0, len(numbers), step):
            size = lengths[a : a + step]
            row = np.repeat(np.arange(a, a + len(size)), size)
            within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            start = post.at[post.starts[term[row, 0]] + within] - offset[row, 0]
            for k in range(1, n):
                ok = post.has(term[row, k], start + offset[row, k])
                row, start = row[ok], start[ok]
            ok = start >= 0
            row, start = row[ok], start[ok]
            ok = post.document(start) == post.document(start + n - 1)
            row, start = row[ok], start[ok]
            out.append((numbers[row], start, np.full(len(row), n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def proximity_matches(post: Postings, asked: Asked, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, anchor) where a document has each term of the window within `span` words of the rarest term's anchor."""
    none = np.empty(0, np.int64)
    out = [(none, none)]
    for number, (first, size) in enumerate(zip(asked.first.tolist(), asked.sizes.tolist(), strict=True)):
        each = list(dict.fromkeys(asked.term[first : first + size].tolist()))
        if min(each) < 0:
            continue
        near = post.of(each[0])
        for t in each[1:]:
            there, doc = post.of(t), post.document(near)
            right = np.searchsorted(there, near)
            after, before = there[np.minimum(right, len(there) - 1)], there[np.maximum(right - 1, 0)]
            ok = (after >= near) & (after - near <= span) & (post.document(after) == doc)
            ok |= (before <= near) & (near - before <= span) & (post.document(before) == doc)
            near = near[ok]
        out.append((np.full(len(near), number), near))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _met(proximity: int | None):
    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        names = {"_at": pa.struct([("file", pa.int64()), ("row", pa.int64())]), "hits": pa.list_(pa.int32()), "windows": pa.list_(pa.binary()), "near": pa.list_(pa.binary())}
        schema = pa.schema(list(names.items()))
        if not asked.num_rows or not found.num_rows:
            return schema.empty_table()
        post = Postings(found.column("term").to_pylist(), found.column("data").to_pylist())
        ids = asked.column("w")
        windows = Asked(post, asked.column("terms").combine_chunks())
        which, start, length = phrase_matches(post, windows)
        doc = post.document(start)
        near_which, near_at = proximity_matches(post, windows, proximity) if proximity is not None else (start[:0], start[:0])
        near_doc = post.document(near_at)
        order, near_order = np.argsort(doc, kind="stable"), np.argsort(near_doc, kind="stable")
        rows = []
        for d in np.union1d(doc, near_doc).tolist():
            own = order[slice(*np.searchsorted(doc[order], [d, d + 1]))]
            close = near_order[slice(*np.searchsorted(near_doc[near_order], [d, d + 1]))]
            file, row, begin, n = post.docs[d].tolist()
            hit = np.zeros(n + 1, np.int32)
            np.add.at(hit, start[own] - begin, 1)
            np.add.at(hit, start[own] - begin + length[own], -1)
            rows.append(({"file": file, "row": row}, np.flatnonzero(np.cumsum(hit)), ids.take(np.unique(which[own])).to_pylist(), ids.take(np.unique(near_which[close])).to_pylist()))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(names.values())], schema=schema)

    return run


def phrase_hits(index: DataFrame, bench: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text", proximity: int | None = None) -> DataFrame:
    """(_at, hits, items, near_items) of the documents that match; as `decontaminate` says. Stored."""
    windows = written(windows_of(bench, width, item_col, text_col), "windows")
    index = asked_postings(index, windows)
    asked = written(candidates(index, written(ranked_windows(index, windows), "ranked")), "candidates")
    wanted = asked.select("block", F.explode(F.transform("terms", lambda t: t["term"])).alias("term"))
    wanted = wanted.unionByName(asked.select("block", F.lit(b"").alias("term"))).distinct()
    found = index.join(wanted, ["block", "term"], "left_semi").select("block", "term", "data")
    matched = asked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_met(proximity), f"_at {PLACE}, hits array<int>, windows array<binary>, near array<binary>")
    matched = written(matched, "matched")
    items = windows.select("w", "item").distinct()
    named = lambda c: matched.select("_at", F.explode(c).alias("w")).join(items, "w").groupBy("_at").agg(F.sort_array(F.collect_set("item")).alias("x"))
    none = F.array().cast("array<string>")
    out = matched.select("_at", "hits").join(named("windows").withColumnRenamed("x", "items"), "_at", "left").withColumn("items", F.coalesce("items", none))
    if proximity is None:
        return out.withColumn("near_items", none)
    return out.join(named("near").withColumnRenamed("x", "near_items"), "_at", "left").withColumn("near_items", F.coalesce("near_items", none))


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", proximity: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns those in `keep`) with n_words, hits (sorted word positions inside matched windows) and
    items (sorted ids with a match).

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. A null
    text has no words; an item without words matches nothing. With `proximity` = s there is also near_items: items
    with a window all of whose terms a document has within s words of the one that is rarest in the corpus. Repeated
    rows each get their result; columns named like the new ones are replaced; an empty table gives an empty one.
    Results come by place (see `placed`): keep few columns, or join hits to texts only where there are any.
    """
    made = ["n_words", "hits", "items"] + (["near_items"] if proximity is not None else [])
    rows = placed(docs)
    index = build_index(rows.select("_at", F.col(f"`{text_col}`").alias("text")))
    hits = phrase_hits(index, bench, width, item_col, bench_text_col, proximity)
    result = written(documents(index).join(hits, "_at", "left"), "hits")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    out = rows.select("_at", F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in names]).alias("_row")).join(result, "_at")
    empty = {"hits": "array<int>", "items": "array<string>", "near_items": "array<string>"}
    new = [F.coalesce(c, F.array().cast(empty[c])).alias(c) if c in empty else F.col(c) for c in made]
    return out.select(*[F.col(f"_row.`{c}`") for c in names], *new)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, bench, keep=["doc_id"])
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The same by hashed windows: all windows of a document against all windows of the benchmark.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
