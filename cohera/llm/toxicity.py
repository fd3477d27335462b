"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, neighbouring pairs, and pairs with one word between, each a 40-bit hash.
Learning rates are per coordinate; the L1 term keeps most weights at exactly zero, so that the model is a short
sorted array of hashes and weights. A text's score is the logistic of the bias and the weights of its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohera.llm.memory import lean


#: A-Z in lower case; every ASCII character that is no letter or digit parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BITS, _SIEVE = np.uint64(24), 20


def features(text: bytes | None) -> np.ndarray:
    """Hashes of the text's words, neighbouring pairs and pairs around one word, repeats included."""
    words = (text or b"").translate(_FOLD).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
    pairs = (mixed[:-1] * np.uint64(3) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    skips = (mixed[:-2] * np.uint64(5) + h[2:]) * np.uint64(0x165667B19E3779F9)
    return np.concatenate([h, pairs, skips]) >> _BITS


class Model:
    """Sorted feature hashes with their weights, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.sieve = None

    def __getstate__(self):
        return self.hashes, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: bytes | None) -> float:
        if self.sieve is None:
            self.sieve = np.zeros(1 << _SIEVE, bool)
            self.sieve[self.hashes & np.uint64((1 << _SIEVE) - 1)] = True
        f = features(text)
        f = np.unique(f[self.sieve[f & np.uint64((1 << _SIEVE) - 1)]])
        if len(f) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, f), len(self.hashes) - 1)
            total = self.bias + float(self.weights[at[self.hashes[at] == f]].sum())
        else:
            total = self.bias
        return float(1 / (1 + np.exp(-min(max(total, -60.0), 60.0))))


def fit(texts: list[bytes], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3, least_docs: int = 5, seed: int = 42) -> Model:
    """FTRL-proximal over the rows in a seeded random order, `epochs` times; features of fewer documents stay out."""
    own = [np.unique(features(t)) for t in texts]
    empty = np.empty(0, np.uint64)
    if not own:
        return Model(empty, np.empty(0), -60.0)
    every, counts = np.unique(np.concatenate(own), return_counts=True)
    every = every[counts >= least_docs]
    rows = []
    for f in own:
        at = np.searchsorted(every, f)
        at[at == len(every)] = 0
        rows.append(at[every[at] == f].astype(np.int32) if len(every) else np.empty(0, np.int32))
    z, n = np.zeros(len(every)), np.zeros(len(every))
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w, b = weight(zi, ni), -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g2
            bias_z += g - (np.sqrt(bias_n + g2) - np.sqrt(bias_n)) / alpha * b
            bias_n += g2
    w = weight(z, n)
    used = w != 0
    return Model(every[used], w[used], float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)))


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 8_000, held_fold: int = 2) -> Model:
    """Fit on at most about `most_rows` labelled rows (this bound is the sample's only limit) outside `held_fold`.

    The sample is drawn by a hash of the id, so it is the same on every run; whole texts are used. Rows without id or
    label teach nothing. Without any labelled row all scores are 0. Only the sampled ids are broadcast, and only the
    weights that aren't zero reach the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != held_fold))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = known.count()
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1_000_003)) < int(1_000_003 * most_rows / n))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), id_col)
    rows = rows.select(F.xxhash64(id_col).alias("order"), "text", F.col("label").cast("int"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).sort_by([("order", "ascending"), ("text", "ascending")])
            model = fit(table.column("text").cast(pa.binary()).to_pylist(), table.column("label").to_numpy())
        else:
            model = fit([], np.empty(0))
        hashes = np.r_[model.hashes.view(np.int64), -1]
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.r_[model.weights, model.bias])], ["h", "w"])

    got = rows.repartition(1).mapInArrow(lean(learn), "h bigint, w double").toPandas()
    bias = got.loc[got.h == -1, "w"]
    got = got[got.h != -1].sort_values("h")
    return Model(got.h.to_numpy(np.int64).view(np.uint64), got.w.to_numpy(float), float(bias.iloc[0]) if len(bias) else -60.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) of every whole text; a null text is scored as an empty one.

    Rows stay as they are; a column named like the new one is replaced; an empty table gives an empty one.
    """
    kept = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema.names)

    return kept.mapInArrow(lean(run), schema)


#: A text is called toxic from this score on.
LIMIT = 0.3


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels))
    held = F.coalesce(fold() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
