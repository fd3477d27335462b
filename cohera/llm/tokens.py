"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

For a word the encoding of each prefix ends in exactly one token: the vocabulary entry t that is a suffix of the
prefix and that byte-pair merging keeps apart from the last token of what precedes it. So count[i] =
count[i - len(t)] + 1, and one pass gives the exact count at every prefix. An automaton over the vocabulary, built as
words ask for it, names the entries that end at a byte, longest first. Texts are cut where the
pre-tokenizer's decision on one side can't change the other's, and each distinct piece is worked out once a worker.

Stored form: int16 differences, one for each character; their running sum is the token count of each prefix.
`tokens_at` and `longest_within` answer budget and truncation questions from it without encoding again.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cohera.llm.memory import Memory, lean
from cohera.plans.shared import written

# Fixed values of the byte-level pre-tokenizer: its contractions.
_CONTRACTION = r"'(?:s|t|re|ve|m|ll|d)"
_SPACE_RUN = regex.compile(r"\s | \Z|\A ")
_LATER_SCRIPTS = regex.compile(r"[^\x00-\u052f]+")
#: Distinct pieces that a worker remembers (twice over, at most), and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 48
_NO_RANK = 1 << 40


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: visible Latin-1 is itself, the rest follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class _State:
    """What reading a word knows: the longest end that begins a vocabulary entry, and the entries that are ends, longest first."""

    __slots__ = ("held", "ends", "next")

    def __init__(self, held: bytes, ends: list[tuple[int, int, bytes]]):
        self.held, self.ends, self.next = held, ends, {}


class PrefixCounter:
    """Counts tokens at every prefix as the tokenizer file's own encoder would, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.number = {raw(t): i for i, t in enumerate(spec["model"]["vocab"]) if t not in special}
        self.heads = {t[:i] for t in self.number for i in range(1, len(t) + 1)}
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.states = {b"": _State(b"", [])}
        self.apart: dict[int, bool] = {}
        self.runs = Memory(self._run, REMEMBERED, LONGEST)
        self.spaced = Memory(lambda piece: self._pieces(" " + piece), REMEMBERED, LONGEST)
        self.units = Memory(self._pieces, 50_000, LONGEST)
        self.library, self.checked, self.odd = Tokenizer.from_file(path).pre_tokenizer, set(), {"L": "", "N": "", "O": ""}
        self._classes()

    def _classes(self) -> None:
        """Compile the classes: those of `regex`, but for characters that the library is known to see otherwise."""
        odd = {k: regex.escape(v, special_only=False) for k, v in self.odd.items()}
        every = "".join(odd.values())
        letter, number = (rf"[\p{{{c}}}{odd[c]}]" if not every else rf"[[\p{{{c}}}--[{every}]]{odd[c]}]" for c in "LN")
        other = r"[^\s\p{L}\p{N}]" if not every else rf"[[^\s\p{{L}}\p{{N}}]--[{every}]]" if not odd["O"] else rf"[[[^\s\p{{L}}\p{{N}}]--[{every}]]{odd['O']}]"
        core = f"{letter}+|{number}+|{other}+"
        #: White space with the one word, number or symbol run after it. A space binds to the run; other white space doesn't.
        self.unit = regex.compile(rf"{_CONTRACTION}|\s*[^\S ]{_CONTRACTION}|\s*(?:{core})|\s+", regex.V1)
        self.parts = regex.compile(rf"(\s*)({_CONTRACTION}|{core})?", regex.V1)
        for memory in (self.spaced, self.units):
            memory.forget()

    def _agree(self, text: str) -> None:
        """Ask the library about each later character once: its tables of letters can be of another Unicode version."""
        new = {c for run in _LATER_SCRIPTS.findall(text) for c in run} - self.checked
        for c in new:
            joined = {a for a, _ in (s for _, s in self.library.pre_tokenize_str(f"\na{c}1{c}!{c}\n"))}
            kind = "L" if 2 not in joined else "N" if 4 not in joined else "O" if 6 not in joined else ""
            mine = "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "" if regex.match(r"\s", c) else "O"
            if kind and kind != mine:
                self.odd[kind] += c
        self.checked |= new
        if any(c in v for c in new for v in self.odd.values()):
            self._classes()

    def merge(self, word: bytes) -> list[bytes]:
        """Byte-pair merging of one word: the pair of least rank first, of equal ones the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, _NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
            if (best := min(ranks)) == _NO_RANK:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _step(self, state: _State, byte: int) -> _State:
        """The state after one more byte: the longest end of what was read that begins an entry of the vocabulary."""
        held = state.held + bytes((byte,))
        while held and held not in self.heads:
            held = held[1:]
        if (after := self.states.get(held)) is None:
            ends = [held[k:] for k in range(len(held))]
            after = self.states[held] = _State(held, [(len(t), self.number[t], t) for t in ends if t in self.number and self.merge(t) == [t]])
        state.next[byte] = after
        return after

    def _run(self, run: str) -> bytes:
        """Differences over one pre-token."""
        word = run.encode()
        state, apart = self.states[b""], self.apart
        count, last, names = [0], [0], [b""]
        for i, byte in enumerate(word, 1):
            state = state.next.get(byte) or self._step(state, byte)
            for size, number, tail in state.ends:
                j = i - size
                if not j:
                    break
                pair = last[j] << 32 | number
                if (ok := apart.get(pair)) is None:
                    if len(apart) > 2_000_000:
                        apart.clear()
                    ok = apart[pair] = self.merge(names[j] + tail) == [names[j], tail]
                if ok:
                    break
            else:
                raise ValueError("the vocabulary can't encode this text")
            count.append(count[j] + 1)
            last.append(number)
            names.append(tail)
        if len(word) != len(run):
            count = [0, *(count[k] for k in range(1, len(word) + 1) if k == len(word) or word[k] & 0xC0 != 0x80)]
        return array("h", map(int.__sub__, count[1:], count)).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Differences over a unit that has more than a space before its run, or is a contraction."""
        space, core = self.parts.match(unit).groups()
        if space and core and len(space) + len(core) < len(unit):  # " 's": the quote binds to the space
            core = unit[len(space) :]
        if not core:
            return self.runs[space]
        out = array("h", self.runs[space] if space else b"")
        base = sum(out)  # what the cut text has; the whole text has `head`
        if space.endswith(" "):
            head = sum(array("h", self.runs[space[:-1]])) if len(space) > 1 else 0
            own = array("h", self.runs[" " + core])
            first, own = own[0], own[1:]
            own[0] += head + first - base
            return (out + own).tobytes()
        head = 0
        if space:
            head = (sum(array("h", self.runs[space[:-1]])) if len(space) > 1 else 0) + array("h", self.runs[space[-1]])[0]
        own = array("h", self.runs[core])
        if core[0] == "'" and len(core) > 1 and regex.fullmatch(_CONTRACTION, core):  # a cut "'ll" leaves the quote alone
            total = sum(own)
            own = array("h", self.runs["'"]) + (array("h", self.runs[core[1:-1]]) if len(core) > 2 else array("h"))
            own.append(total - sum(own))
        own[0] += head - base
        return (out + own).tobytes()

    def _pieces(self, text: str) -> bytes:
        """Differences over a text in which no unit depends on what stands before."""
        plain, runs = self.plain, self.runs
        return b"".join([runs[u] if plain(u) else self._unit(u) for u in self.unit.findall(text)])

    @staticmethod
    def plain(unit: str) -> bool:
        """At most one space before the run, and no contraction: the cuts of its one pre-token are those of the unit."""
        return not (unit[0] == "'" or unit[0] != " " and unit[0].isspace() or unit[0] == " " and unit[1:2].isspace())

    def ordinary(self, text: str) -> bytes:
        """Differences of a text without special tokens."""
        if not text:
            return b""
        if not text.isascii() and _LATER_SCRIPTS.search(text):
            self._agree(text)
        if _SPACE_RUN.search(text):
            return b"".join(self._stitched(text))
        first, *rest = text.split(" ")
        return self.units[first] + b"".join(map(self.spaced.__getitem__, rest))

    def _stitched(self, text: str) -> Iterator[bytes]:
        yield from map(self.units.__getitem__, self.unit.findall(text))

    def differences(self, text: str) -> bytes:
        """The stored form: int16 differences by character. Special tokens in the text count as one each."""
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            cut = np.frombuffer(self.ordinary(text[at : m.end()]), "<i2").astype(np.int64)
            whole = int(np.frombuffer(self.ordinary(text[at : m.start()]), "<i2").sum()) + 1
            out.append(np.r_[cut[:-1], whole - cut[:-1].sum()].astype("<i2").tobytes())
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokens_at(stored: bytes, chars: int) -> int:
    """Tokens of the prefix of `chars` characters."""
    return int(np.frombuffer(stored, "<i2", min(chars, len(stored) // 2)).sum(dtype=np.int64))


def longest_within(stored: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(stored, "<i2"), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and prefix_deltas (the stored form).

    A null text counts as empty: zeros. Bytes that aren't UTF-8 count as replacement characters. Rows stay as they
    are, repeated ones too; columns of `docs` named like the new ones are replaced; an empty table gives an empty one.
    A text is one row's work at any length; only pieces of up to LONGEST characters are remembered, and at most
    REMEMBERED of them.
    """
    kinds = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "prefix_deltas": T.BinaryType()}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in kinds or c == text_col])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in kinds.items()]])
    at, where = kept.columns.index(text_col), path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(where)
        for batch in batches:
            n_bytes, n_tokens, stored = [], [], []
            for value in batch.column(at).cast(pa.binary()):
                raw = value.as_py() or b""
                deltas = count.differences(raw.decode("utf-8", "replace"))
                n_bytes.append(len(raw))
                n_tokens.append(int(np.frombuffer(deltas, "<i2").sum(dtype=np.int64)))
                stored.append(deltas)
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return kept.mapInArrow(lean(run), schema)


def within_budget(counted: DataFrame, budget: int = 1024) -> DataFrame:
    """`counted` with fit_chars in place of prefix_deltas: characters of the longest prefix of at most `budget` tokens.

    Answered from the stored counts; no text is read or encoded. A null count gives null.
    """
    names = [c for c in counted.columns if c not in ("prefix_deltas", "fit_chars")]
    rows = counted.select("prefix_deltas", *[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fit_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [None if v.as_py() is None else longest_within(v.as_py(), budget) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fit, pa.int64())], schema.names)

    return rows.mapInArrow(lean(run), schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = written(prefix_token_counts(docs).drop("text"), "prefixes")
    return within_budget(stored).selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit", "fit_chars")
