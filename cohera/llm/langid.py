"""Language identification by interpolated Kneser-Ney character models.

One model a language, of n-grams within words (between a start and an end mark). The full interpolated log
probability of every seen n-gram, and the back-off weight of every seen context, lie in sorted arrays of 64-bit
hashes. A text's language is that of the lowest cross-entropy per character; a calibrated logistic curve turns the
lead over the second-best language into a score, and a text whose cross-entropy is above the calibrated quantile of
its language is marked as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohera.llm.toxicity import fold

ORDER, START, END = 5, "\x02", "\x03"
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: ASCII characters that are no letters part words; the text is lower-cased before.
_PART = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Words that a worker remembers scores of.
REMEMBERED = 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, in lower case."""
    return text.lower().encode().translate(_PART).split()


def _grams(distinct: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(word of each position, position in its word, [hash of the n-gram ending there, n = 1..order], code).

    Positions are the characters of a word and its end mark. n-grams that would begin before the start mark are 0.
    """
    flat = "".join(f"{START}{w}{END}" for w in distinct)
    codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum([0, *(len(w) + 2 for w in distinct)])
    word = np.repeat(np.arange(len(distinct)), np.diff(begins))
    place = np.arange(len(codes)) - begins[word]
    hashes, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        shifted = np.r_[np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]]
        # The character n - 1 places back joins the hash with a weight of its own place.
        h = h + (shifted + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, 2 * n + 1, 1 << 64))
        mixed = (h ^ (h >> np.uint64(31))) * _MULT
        hashes.append(np.where(place >= n - 1, mixed | np.uint64(1), np.uint64(0)))
    return word, place, hashes, codes


class KneserNey:
    """One language's model, built from distinct words and their counts."""

    def __init__(self, distinct: list[str], counts: np.ndarray, order: int = ORDER, discount: float = 0.75):
        self.order = order
        word, place, hashes, codes = _grams(distinct, order)
        scored = place > 0
        weight = counts[word].astype(float)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        alphabet = len(np.unique(codes[scored])) + 1 if scored.any() else 1
        lower_hash = lower_p = None
        for n in range(1, order + 1):
            ok = scored & (place >= n - 1)
            keys, at, inverse = np.unique(hashes[n - 1][ok], return_index=True, return_inverse=True)
            raw = np.bincount(inverse, weight[ok], len(keys)) if len(keys) else np.empty(0)
            if n < order and len(keys):
                # Continuation counts: distinct (n+1)-grams that end in this one; n-grams from the start mark keep theirs.
                longer = np.flatnonzero(ok)[at]
                starts = place[longer] == n - 1
                inner = ok & (place >= n)
                _, first = np.unique(hashes[n][inner], return_index=True)
                ends = np.searchsorted(keys, hashes[n - 1][inner][first])
                kinds = np.bincount(ends, minlength=len(keys)).astype(float)
                raw = np.where(starts, raw, kinds)
            where = np.flatnonzero(ok)[at]
            context = hashes[n - 2][where - 1] if n > 1 else np.zeros(len(where), np.uint64)
            ctx, which = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(which, raw, len(ctx)), np.bincount(which, minlength=len(ctx))
            gamma = discount * kinds / np.maximum(total, 1e-9)
            if n == 1:
                below = np.full(len(keys), 1 / alphabet)
            else:
                below = lower_p[np.searchsorted(lower_hash, hashes[n - 2][where])]
            p = np.maximum(raw - discount, 0) / np.maximum(total[which], 1e-9) + gamma[which] * below
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(ctx)
            self.backoff.append(np.log(np.minimum(gamma, 1.0)).astype(np.float32))
            lower_hash, lower_p = keys, p
        self.unknown = float(np.log(1 / alphabet)) + (float(self.backoff[0][0]) if len(self.backoff[0]) else 0.0)

    def score(self, grams: tuple, n_words: int) -> np.ndarray:
        """Summed log probability of each word of `grams`."""
        word, place, hashes, _ = grams
        out, open_ = np.zeros(len(word)), np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            if not len(open_):
                break
            can = place[open_] >= n - 1
            at = open_[can]
            if not len(at):
                continue
            found, where = _find(self.keys[n - 1], hashes[n - 1][at])
            out[at[found]] += self.logp[n - 1][where[found]]
            lost = at[~found]
            if n > 1 and len(lost):
                known, where = _find(self.contexts[n - 1], hashes[n - 2][lost - 1])
                out[lost[known]] += self.backoff[n - 1][where[known]]
            open_ = np.concatenate([open_[~can], lost])
        out[open_] += self.unknown
        return np.bincount(word, out, n_words)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Identifier:
    """Models by language, and their calibration."""

    def __init__(self, models: dict[str, KneserNey], curve: tuple[float, float] = (0.0, 1.0), limits: dict[str, float] | None = None):
        self.langs, self.models = sorted(models), models
        self.curve, self.limits = curve, limits or {}
        #: The limit of a language that no calibration row was recognised in.
        self.loosest = max(self.limits.values(), default=np.inf)
        self._clear()

    def __getstate__(self):
        return self.models, self.curve, self.limits

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1), np.float32)

    def _learn_words(self, new: set[bytes]) -> None:
        if len(self.rows) + len(new) > REMEMBERED:
            self._clear()
        fresh = list(new)
        texts = [w.decode("utf-8", "replace") for w in fresh]
        grams = _grams(texts, ORDER)
        cols = [self.models[k].score(grams, len(texts)) for k in self.langs] + [np.array([len(t) + 1 for t in texts], float)]
        base = len(self.rows)
        self.table = np.concatenate([self.table[:base], np.stack(cols, axis=1).astype(np.float32)])
        self.rows.update((w, base + i) for i, w in enumerate(fresh))

    def entropies(self, texts: list[str]) -> list[tuple[np.ndarray, float] | None]:
        """Per text: cross-entropy by language (nats a character) and its length; None without a letter."""
        out: list[tuple[np.ndarray, float] | None] = []
        for lo in range(0, len(texts), 200):
            split = [words(t) for t in texts[lo : lo + 200]]
            every = set().union(*split)
            if new := every.difference(self.rows):
                if len(self.rows) + len(new) > REMEMBERED:
                    self._clear()
                    new = every
                self._learn_words(new)
            for text, own in zip(texts[lo : lo + 200], split, strict=True):
                if not own or not (own[0][0] in _ASCII_LETTER or _LETTER.search(text)):
                    out.append(None)
                    continue
                sums = self.table[np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))].sum(axis=0, dtype=np.float64)
                out.append((-sums[:-1] / sums[-1], float(sums[-1])))
        return out

    def evidence(self, entropy: np.ndarray, length: float) -> float:
        """The lead over the second language, in nats over the whole text, on a log scale."""
        low = np.sort(entropy)
        lead = low[1] - low[0] if len(low) > 1 else 1.0
        return float(np.log1p(max(lead, 0.0) * length))

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        out = []
        for found in self.entropies(texts):
            if found is None or not self.langs:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            entropy, length = found
            best = int(np.argmin(entropy))
            a, b = self.curve
            score = float(1 / (1 + np.exp(-(a + b * self.evidence(entropy, length)))))
            low = float(entropy[best])
            out.append((self.langs[best], score, low, low > self.limits.get(self.langs[best], self.loosest)))
        return out

    def calibrate(self, texts: list[str], langs: list[str], quantile: float = 0.999) -> None:
        """Fit the logistic curve from lead to correctness, and each language's limit, on texts not trained on."""
        self.fit(self.judged(texts, langs), quantile)

    def judged(self, texts: list[str], langs: list[str]) -> list[tuple[str, float, bool, float]]:
        """(language, evidence, right, cross-entropy) of each text with a letter."""
        out = []
        for found, lang in zip(self.entropies(texts), langs, strict=True):
            if found is not None:
                best = int(np.argmin(found[0]))
                out.append((lang, self.evidence(*found), self.langs[best] == lang, float(found[0][best])))
        return out

    def fit(self, judged: list[tuple[str, float, bool, float]], quantile: float = 0.999) -> None:
        """Two pseudo-rows (a tie that is half right) and a small ridge keep the curve finite where all are right."""
        xs, ys, lows = [0.0, 0.0], [0.0, 1.0], {}
        for lang, evidence, right, low in judged:
            xs.append(evidence)
            ys.append(float(right))
            if right:
                lows.setdefault(lang, []).append(low)
        x, y, ab = np.stack([np.ones(len(xs)), xs], axis=1), np.array(ys), np.array([0.0, 1.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
            grad = x.T @ (p - y) + 0.1 * (ab - [0.0, 1.0])
            ab = ab - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        self.curve = (float(ab[0]), float(max(ab[1], 0.0)))
        self.limits = {k: float(np.quantile(v, quantile)) * 1.1 for k, v in lows.items()}
        self.loosest = max(self.limits.values(), default=np.inf)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 1_500, held_fold: int = 2, calibration_fold: int = 3) -> Identifier:
    """Fit on at most about `most_docs` whole texts a language (the sample's only limit), drawn by a hash of the id.

    Rows of `held_fold`, and rows without id, text or language, teach nothing; rows of `calibration_fold` calibrate.
    Words are counted where they lie; a task then builds each language's model from its distinct words. All drawn texts
    of `calibration_fold` (about a third of `most_docs` a language) are judged where they lie; four values of each
    reach the driver.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold"))
    known = known.filter(F.col("lang").isNotNull() & F.col("fold").isNotNull() & (F.col("fold") != held_fold))
    tuning = F.col("fold") == calibration_fold
    counts = known.groupBy("lang", tuning.alias("tuning")).count().collect()
    if not counts:
        return Identifier({})
    draw = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_003))
    rates = {(r["lang"], r["tuning"]): int(1_000_003 * min(1.0, most_docs / r["count"] / (3 if r["tuning"] else 1))) for r in counts}
    limit = F.create_map(*[F.lit(x) for (lang, t), v in rates.items() for x in (f"{int(t)}{lang}", v)])
    sample = known.filter((draw < limit[F.concat(tuning.cast("int").cast("string"), "lang")]) & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((lang, w) for w in words(text))
            rows = [(lang, w.decode("utf-8", "replace"), n) for (lang, w), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        pdf = pdf.sort_values("word")
        model = KneserNey(pdf.word.tolist(), pdf.n.to_numpy())
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "model": [pickle.dumps(model)]})

    counted = sample.filter(~tuning).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    import pickle

    models = {r["lang"]: pickle.loads(bytes(r["model"])) for r in counted.groupBy("lang").applyInPandas(build, "lang string, model binary").collect()}
    made = Identifier(models)
    if models:
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = shared.value.judged(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))], ["lang", "evidence", "right", "low"])

        judged = sample.filter(tuning).select("text", "lang").mapInArrow(judge, "lang string, evidence double, right boolean, low double")
        made = Identifier(models)
        made.fit(sorted(tuple(r) for r in judged.collect()))
    return made


def identify(docs: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected, from whole texts.

    A null text, or one without a letter, is `und` with score 0 and is rejected. Ties go to the language that sorts
    first. Rows stay as they are; columns named like the new ones are replaced; an empty table gives an empty one.
    """
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}
    kept = docs.select(*[c for c in docs.columns if c not in kinds or c == text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column(at).cast(pa.binary())]
            found = m.predict(texts)
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return kept.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(fold() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
