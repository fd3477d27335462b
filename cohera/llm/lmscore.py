"""Masked pseudo-likelihood of documents under a bidirectional window network, trained in numpy.

The network predicts each token from the two on either side: their embeddings (one table a place) are added and
squashed, and a two-step softmax gives the token's class and the token within its class. The vocabulary is counted
over all documents; then their words are stored as numbers, which all later steps read. Training begins with a bounded
sample in one task, which gives all a common start; then every partition goes over all of its documents once, and the
partitions' parameters are averaged by tokens seen. The model thus depends on how the documents are split into
partitions, as it does in any parallel training of this kind. Words without a number of their own share a bucket, and
each has its share of the bucket's tokens over the whole corpus. A document's score is the sum of
log p(token | both sides) over its tokens.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohera.llm.memory import lean
from cohera.plans.shared import written

#: Words with a number of their own at least, and buckets that all other words share by hash.
KNOWN, BUCKETS = 4_096, 256
CLASSES = 64
#: Distinct words up to which KNOWN and CLASSES hold; beyond, classes grow with the eighth root of their number.
DISTINCT = 400_000
#: Words next in frequency whose counts every worker holds; the counts of all others are joined.
HELD = 300_000
#: Bytes of text that are encoded together, and tokens that are gone over together (a longer text is taken by itself).
SLICE_BYTES, SLICE_TOKENS = 2_000_000, 330_000
WIDTH, SIDE = 16, 2
BATCH = 16_384
#: Rows of a batch whose softmax is formed at once, so that it stays in a core's cache.
ROWS = 512
#: Logits up to which exp() is taken as they are in single precision; rows that may have larger ones are lowered first.
TAME = 60
RATE = 0.11


def words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def sizes(distinct: int) -> tuple[int, int]:
    """(words with a number of their own, classes) for so many distinct words; a class has about as many words as there are classes."""
    classes = max(CLASSES, int(np.ceil(CLASSES * (distinct / DISTINCT) ** 0.125)))
    return classes * (classes + BUCKETS // CLASSES) - BUCKETS, classes


class _Numbers(dict):
    """Numbers of known words; any other word's is its bucket's."""

    def __init__(self, ordered: list[bytes], known: int):
        super().__init__((w, i) for i, w in enumerate(ordered))
        self.known = known

    def __missing__(self, word: bytes) -> int:
        return self.known + zlib.crc32(word) % BUCKETS

    def __reduce__(self):
        return _Numbers, (list(self), self.known)


class Vocabulary:
    """Word numbers: by falling frequency, then the buckets, then the mark outside documents."""

    def __init__(self, ordered: list[bytes], known: int = KNOWN, in_buckets: np.ndarray | None = None, held: tuple[np.ndarray, np.ndarray] | None = None):
        """`in_buckets`: tokens of each bucket over all documents; `held`: hashes (ascending) and log counts of rare words."""
        self.held = held or (np.empty(0, np.int64), np.empty(0))
        self.known, self.number = known, _Numbers(ordered, known)
        self.outside = known + BUCKETS
        #: By number: log of what a word's count is divided by; one token of a bucket is kept for words never seen.
        self.log_total = np.zeros(self.outside)
        if in_buckets is not None:
            self.log_total[known:] = np.log(in_buckets + 1.0)

    def shares(self, rare: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words that only have a bucket: log counts (0 if not held), whether they aren't held, hashes (Spark's xxhash64)."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, rare, repeat(42)), np.uint64, len(rare)).view(np.int64)
        keys, logs = self.held
        if not len(keys):
            return np.zeros(len(hashes)), np.ones(len(hashes), bool), hashes
        order, at = np.argsort(hashes), np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(keys, hashes[order])  # in order, neighbours are found near each other
        at = np.minimum(at, len(keys) - 1)
        here = keys[at] == hashes
        return np.where(here, logs[at], 0.0), ~here, hashes

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(numbers of the texts' words, words of each text, words that only have a bucket)."""
        by_text = [words(text) for text in texts]
        own = list(chain.from_iterable(by_text))
        ids = np.fromiter(map(self.number.get, own, repeat(-1)), np.int64, len(own))
        unknown = ids < 0
        rare = list(compress(own, unknown.tolist()))
        ids[unknown] = np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % BUCKETS + self.known
        return ids, np.fromiter(map(len, by_text), np.int64, len(texts)), rare

    @property
    def kind(self) -> np.dtype:
        """What a number is stored as."""
        return np.dtype("<u2" if self.outside < 65_536 else "<i4")

    def laid(self, stored: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' stored numbers: (numbers with marks between texts, places of tokens, text of each token)."""
        sizes = np.fromiter(map(len, stored), np.int64, len(stored)) // self.kind.itemsize
        text = np.repeat(np.arange(len(stored)), sizes)
        ids, place = np.full(len(text) + SIDE * (len(stored) + 1), self.outside, np.int32), np.arange(len(text)) + SIDE * (text + 1)
        ids[place] = np.frombuffer(b"".join(stored), self.kind)
        return ids, place, text


class Network:
    """Parameters: emb (place, word, width), bias; class and word softmax weights."""

    NAMES = ("emb", "bias", "cls", "cls_bias", "out", "out_bias")
    #: The least size.
    _TOTAL = KNOWN + BUCKETS
    OFFSETS = tuple(k for k in range(-SIDE, SIDE + 1) if k)

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.classes, _, self.per_class = params["out"].shape

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 42, classes: int = CLASSES) -> Network:
        """Small random embeddings; the output biases are the words' log frequencies."""
        rng, m = np.random.default_rng(seed), len(counts) // classes
        c = (counts + 1.0).reshape(classes, m)
        return cls({
            "emb": rng.normal(0, 0.1, (2 * SIDE, len(counts) + 1, WIDTH)).astype(np.float32), "bias": np.zeros(WIDTH, np.float32),
            "cls": np.zeros((WIDTH, classes), np.float32), "cls_bias": np.log(c.sum(1) / c.sum()).astype(np.float32),
            "out": np.zeros((classes, WIDTH, m), np.float32), "out_bias": np.log(c / c.sum(1, keepdims=True)).astype(np.float32),
        })

    def hidden(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(rows of 1, for the biases, and the hidden values; numbers around by place)."""
        around = [ids[place + k] for k in self.OFFSETS]
        x = self.p["bias"] + self.p["emb"][0].take(around[0], axis=0)
        for k in range(1, len(around)):
            x += self.p["emb"][k].take(around[k], axis=0)
        h = np.ones((len(x), x.shape[1] + 1), x.dtype)
        np.tanh(x, out=h[:, 1:])
        return h, around

    def layers(self) -> list[tuple[np.ndarray, bool]]:
        """The softmax over classes, then that of each class: (rows of bias and weights, whether all logits are tame)."""
        out = []
        for bias, weights in ((self.p["cls_bias"][None], self.p["cls"][None]), (self.p["out_bias"], self.p["out"])):
            rows = np.concatenate([bias[:, None], weights], axis=1)
            out += zip(rows, (np.abs(rows).sum(axis=1).max(axis=1) < TAME).tolist(), strict=True)  # hidden values are within -1 and 1
        return out

    def _sorted(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
        """(an order of the places by class; layer, first and last row, and targets of these rows of each softmax to form)."""
        target = ids[at]
        cls, within = target // self.per_class, target % self.per_class
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls, within = cls[order], within[order]
        ends = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        spans = [(0, 0, len(at), cls), *((c + 1, a, b, within[a:b]) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b)]
        return order, [(k, lo, min(lo + ROWS, b), t[lo - a : lo - a + ROWS]) for k, a, b, t in spans for lo in range(a, b, ROWS)]

    @staticmethod
    def _logits(layer: tuple[np.ndarray, bool], h: np.ndarray) -> np.ndarray:
        z = h @ layer[0]
        if not layer[1]:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_probs(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log p(token | both sides) at each place."""
        out, layers = np.empty(len(place), np.float32), self.layers()
        for lo in range(0, len(place), BATCH):
            at = place[lo : lo + BATCH]
            order, parts = self._sorted(ids, at)
            h, _ = self.hidden(ids, at[order])
            lp = np.zeros(len(at), h.dtype)
            ones, row = np.ones(max(self.classes, self.per_class), h.dtype), np.arange(ROWS)
            for k, a, b, target in parts:
                z = self._logits(layers[k], h[a:b])
                chosen = z[row[: b - a], target]
                np.exp(z, out=z)
                chosen -= np.log(z @ ones[: z.shape[1]])
                lp[a:b] += chosen
            out[lo + order] = lp
        return out

    def train(self, ids: np.ndarray, place: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One pass of Adagrad over the places, in batches; `memory` holds the squared gradients so far."""
        p = self.p
        for lo in range(0, len(place), BATCH):
            at = place[lo : lo + BATCH]
            order, parts = self._sorted(ids, at)
            h, around = self.hidden(ids, at[order])
            layers = self.layers()
            dh, of_cls, of_out = np.zeros_like(h[:, 1:]), np.zeros_like(layers[0][0]), np.zeros((self.classes, *layers[1][0].shape), h.dtype)
            slopes = [of_cls, *of_out]
            ones, row = np.ones(max(self.classes, self.per_class), h.dtype), np.arange(ROWS)
            for k, a, b, target in parts:
                g = self._logits(layers[k], h[a:b])
                np.exp(g, out=g)
                total = g @ ones[: g.shape[1]]
                g[row[: b - a], target] -= total  # the slopes by the logits, times each row's total
                scale = (1 / total)[:, None]
                back = g @ layers[k][0][1:].T
                back *= scale
                dh[a:b] += back
                slopes[k] += (h[a:b] * scale).T @ g
            n = np.float32(len(at))
            of_cls /= n
            of_out /= n
            self._step("cls", ..., of_cls[1:], memory)
            self._step("cls_bias", ..., of_cls[0], memory)
            self._step("out", ..., of_out[:, 1:], memory)
            self._step("out_bias", ..., of_out[:, 0], memory)
            h = h[:, 1:]
            dx = dh * (1 - h * h) / n
            self._step("bias", ..., self._total(dx), memory)
            pairs = dx.view(np.result_type(dx.dtype, np.complex64))  # two columns in one, which halves the sums to be formed
            for k, ctx in enumerate(around):
                by = np.argsort(ctx.astype(np.uint16) if len(p["emb"][k]) <= 65_536 else ctx, kind="stable")
                ordered = ctx[by]
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                self._step("emb", (k, ordered[first]), np.add.reduceat(pairs.take(by, axis=0), first, axis=0).view(dx.dtype), memory)

    @staticmethod
    def _total(g: np.ndarray) -> np.ndarray:
        return np.ones(len(g), g.dtype) @ g

    def _step(self, name: str, where, grad: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        weights, seen = self.p[name], memory[name]
        if isinstance(where, tuple):
            place, where = where
            weights, seen = weights[place], seen[place]
        total = grad * grad
        total += seen[where]
        seen[where] = total
        total += np.float32(1e-8)
        change = np.float32(RATE) * grad
        change /= np.sqrt(total, out=total)
        weights[where] -= change

    def memory(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Network:
        with np.load(io.BytesIO(raw)) as f:
            return cls({k: f[k] for k in cls.NAMES})


def slices(column: pa.Array, most: int) -> Iterator[list[bytes | None]]:
    """The values in runs of about `most` bytes."""
    held, size = [], 0
    for value in column:
        text = value.as_py()
        if held and size + len(text or b"") > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or b"") + 64
    if held:
        yield held


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all documents; counted where they lie, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                found.update(words(t.as_py()))
            if len(found) > 400_000:
                yield _counted(found)
                found = Counter()
        yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """Vocabulary of all documents, tokens by class and number, and the counts of words that share a bucket (h, log_n; without
    those that occur once, whose log is 0, and those that the vocabulary holds)."""
    counted = written(count_words(docs, text_col), "words")
    rung = F.floor(F.log2("n") * 8)  # counts in steps of an eighth of an octave
    ladder = sorted(counted.groupBy(rung.alias("rung")).count().collect(), reverse=True)
    known, classes = sizes(sum(r["count"] for r in ladder))

    def most_frequent(rows: DataFrame, skipped: int, most: int) -> DataFrame:
        """The first `most` rows by falling n, then word; `skipped` words before them. Only rungs that can hold them are sorted."""
        places = np.cumsum([r["count"] for r in ladder])
        last = int(np.searchsorted(places, skipped + most))
        lowest = ladder[last]["rung"] if last < len(ladder) else 0
        return rows.filter(rung >= lowest).orderBy(F.desc("n"), "word").limit(most)

    top = most_frequent(counted, 0, known).collect()
    counts = np.zeros(known + BUCKETS)
    counts[: len(top)] = [r["n"] for r in top]
    beyond = F.lit(False)
    if len(top) == known:
        least, last = top[-1]["n"], F.lit(bytes(top[-1]["word"]))
        beyond = (F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last))
    others = counted.filter(beyond)
    for r in others.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[known + r["b"]] = r["n"]
    log_n = others.filter("n > 1").select(F.xxhash64("word").alias("h"), F.log(F.col("n").cast("double")).alias("log_n"), "n", "word")
    held = most_frequent(log_n, known, HELD).toPandas()
    beyond = F.lit(False)
    if len(held) == HELD:
        edge = held.iloc[-1]
        beyond = (F.col("n") < int(edge.n)) | ((F.col("n") == int(edge.n)) & (F.col("word") > F.lit(bytes(edge.word))))
    held = held.sort_values("h")
    shares = log_n.filter(beyond).select("h", "log_n")
    vocabulary = Vocabulary([bytes(r["word"]) for r in top], known, counts[known:], (held.h.to_numpy(np.int64), held.log_n.to_numpy(float)))
    return vocabulary, counts.reshape(classes, -1), shares


def number(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep_text: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with their texts' words as numbers, written once: row (its columns but those of `without`), at (a number of
    its own), n (tokens), s (log shares of the vocabulary's words in their buckets), rare (hashes of other words that
    only have a bucket), ids (the numbers)."""
    names = [c for c in docs.columns if c not in without and (keep_text or c != text_col)]
    row = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in names]).alias("row")
    kept = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    more = [("n", T.LongType()), ("s", T.DoubleType()), ("rare", T.ArrayType(T.LongType())), ("ids", T.BinaryType())]
    schema = T.StructType([kept.schema["row"], *[T.StructField(*x) for x in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1).cast(pa.binary()), SLICE_BYTES):
                ids, n, rare = vocabulary.numbers(texts)
                logs, unheld, hashes = vocabulary.shares(rare)
                bucket = ids >= vocabulary.known
                doc = np.repeat(np.arange(len(texts)), n)[bucket]
                s = np.bincount(doc, logs - vocabulary.log_total[ids[bucket]], len(texts)).astype(float)  # of no words, it counts in whole numbers
                left = np.bincount(doc[unheld], minlength=len(texts))
                lists = pa.ListArray.from_arrays(pa.array(_offsets(left)), pa.array(hashes[unheld]))
                raw = ids.astype(vocabulary.kind)
                stored = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(_offsets(n * raw.itemsize)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(n), pa.array(s), lists, stored], schema.names)
                done += len(texts)

    return written(kept.mapInArrow(lean(run), schema).withColumn("at", F.monotonically_increasing_id()), "numbered")


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def fit(numbered: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, id_col: str = "doc_id", sample_docs: int = 2_000) -> Network:
    """The network of all numbered documents. Only the common start is fitted on a sample (about `sample_docs`).

    Parameters are a few MB whatever the corpus; each partition sends its own through the shuffle, cut in blocks that
    are averaged in as many tasks: first over runs of 256 partitions, then over the runs, always in order.
    """
    spark = numbered.sparkSession
    share = int(1_000_003 * min(1.0, sample_docs / max(numbered.count(), 1)))
    sample = numbered.filter(F.pmod(F.xxhash64(F.lit(3), F.col(f"row.`{id_col}`")), F.lit(1_000_003)) < share).select("ids")
    begin = Network.fresh(counts.ravel(), classes=len(counts)).pack()
    shared = spark.sparkContext.broadcast((vocabulary, begin))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _locally(batches, *shared.value, passes=2)

    start = [bytes(r["params"]) for r in sample.repartition(1).mapInArrow(lean(first), _MODEL).collect()]
    common = spark.sparkContext.broadcast((vocabulary, start[0] if start else begin))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _locally(batches, *common.value, passes=1)

    models = numbered.select("ids").mapInArrow(lean(own), _MODEL).filter("n > 0").withColumn("part", F.spark_partition_id())
    network = Network.unpack(common.value[1])
    flat, shapes = _flatten(network)
    block = 8_192
    blocks = models.mapInArrow(_cut_blocks(block), _BLOCKS)

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total, summed = float(pdf.n.sum()), 0.0
        for n, weights in zip(pdf.n, pdf.weights, strict=True):
            summed = summed + np.frombuffer(weights, np.float32).astype(np.float64) * (n / total)
        return pd.DataFrame({"block": pdf.block.iloc[:1], "part": pdf.part.iloc[:1] // 256, "n": [int(total)], "weights": [summed.astype(np.float32).tobytes()]})

    runs = blocks.groupBy("block", F.expr("part DIV 256")).applyInPandas(average, _BLOCKS)
    for r in runs.groupBy("block").applyInPandas(average, _BLOCKS).collect():
        flat[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["weights"], np.float32)
    return _shaped(flat, shapes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2_000) -> tuple[Vocabulary, Network, DataFrame]:
    """Vocabulary and network of all documents, and the counts of words that the vocabulary doesn't hold: see count() and fit()."""
    vocabulary, counts, shares = count(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return vocabulary, fit(number(rows, vocabulary, keep_text=False), vocabulary, counts, "id", sample_docs), shares


_MODEL = "n bigint, params binary"
_BLOCKS = "block int, part int, n bigint, weights binary"


def _flatten(network: Network) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    return np.concatenate([network.p[k].ravel() for k in Network.NAMES]), [network.p[k].shape for k in Network.NAMES]


def _shaped(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> Network:
    out, at = {}, 0
    for name, shape in zip(Network.NAMES, shapes, strict=True):
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return Network(out)


def _cut_blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat, _ = _flatten(Network.unpack(raw))
                cuts = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
                cols = [pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([n] * len(cuts), pa.int64()), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "part", "n", "weights"])

    return run


def _locally(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, raw: bytes, passes: int) -> pa.RecordBatch:
    """Train on the batches' numbers from the given parameters; one row: tokens seen, parameters."""
    network, seen = Network.unpack(raw), 0
    memory = network.memory()
    for batch in batches:
        for stored in slices(batch.column(0), SLICE_TOKENS * vocabulary.kind.itemsize):
            ids, place, _ = vocabulary.laid(stored)
            for k in range(passes):
                network.train(ids, np.random.default_rng(k).permutation(place), memory)
            seen += len(place)
    return pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([network.pack()], pa.binary())], ["n", "params"])


def score(docs: DataFrame, model: tuple[Vocabulary, Network, DataFrame], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with n_tokens, log_likelihood (summed) and mean_log_likelihood (null without a token) of whole texts.

    A null text has no tokens. A word without a number of its own scores as its bucket times its share of the bucket;
    one that the model never saw, as one token of it. Rows stay as they are (without texts unless `keep_text`);
    columns named like the new ones are replaced; an empty table gives an empty one.
    """
    return scored(number(docs, model[0], text_col, keep_text, _SCORES), model)


_SCORES = ("n_tokens", "log_likelihood", "mean_log_likelihood")


def scored(numbered: DataFrame, model: tuple[Vocabulary, Network, DataFrame]) -> DataFrame:
    """Scores of documents that number() has gone over with the model's vocabulary: see score()."""
    shared = numbered.sparkSession.sparkContext.broadcast((model[0], model[1].pack()))
    names = [f.name for f in numbered.schema["row"].dataType.fields[1:]]
    rows = numbered.select("row", "at", "n", "s", "ids")
    schema = T.StructType(rows.schema.fields[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = shared.value[0], Network.unpack(shared.value[1])
        for batch in batches:
            sums = [np.empty(0)]
            for stored in slices(batch.column(4), SLICE_TOKENS * vocabulary.kind.itemsize):
                ids, place, doc = vocabulary.laid(stored)
                sums.append(np.bincount(doc, network.log_probs(ids, place), len(stored)))
            s = np.concatenate(sums) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s)], schema.names)

    more = numbered.select("at", F.explode("rare").alias("h")).join(model[2], "h").groupBy("at").agg(F.sum("log_n").alias("more"))
    out = rows.mapInArrow(lean(run), schema).join(more, "at", "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0)))
    scores = (F.col("n"), F.col("s"), F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    return out.select(*[F.col(f"row.`{c}`") for c in names], *[x.alias(c) for x, c in zip(scores, _SCORES, strict=True)])


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary, counts, shares = count(docs)
    numbered = number(docs, vocabulary, keep_text=False)
    return scored(numbered, (vocabulary, fit(numbered, vocabulary, counts), shares))
