"""Sentences, claims, their subject-relation-object parts and polarity, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of negative polarity.
NEGATIVE = [
    r"\bcontradicts?\b", r"\bviolates?\b", r"\bexceeds?\b", r"\binconsistent\b", r"\bfails?\b", r"\bdisproves?\b", r"\brefutes?\b",
    r"\brules?\s+out\b", r"\bincompatible\b", r"\bdisagrees?\b", r"\banomal(?:y|ous|ies)\b", r"\bdeviat(?:es?|ion)\b", r"\btension\b",
    r"\bdiscrepan(?:cy|cies|t)\b", r"\bchallenges?\b", r"\brejected?\b", r"\brunaway\b",
]
# Markers of positive polarity.
POSITIVE = [
    r"\bconfirms?\b", r"\bconsistent\s+with\b", r"\bagrees?\s+with\b", r"\bvalidates?\b", r"\bsupports?\b", r"\bcorroborates?\b",
    r"\bpredicts?\b", r"\breproduces?\b", r"\bverif(?:y|ies|ied)\b", r"\bin\s+(?:good\s+)?agreement\b", r"\bcompatible\s+with\b",
    r"\bconverges?\b", r"\brecovers?\b", r"\bindependently\b",
]
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "vs", "etc", "al", "fig", "eq", "ref", "vol", "no", "approx", "ca", "cf", "e.g", "i.e",
    "et", "phys", "rev", "lett", "apj", "mnras",
)
# Signs of a claim.
CLAIM_SIGNS = [
    r"\bwe\s+(?:find|show|demonstrate|measure|observe|conclude|report|determine)\b",
    r"\bour\s+(?:results?|measurements?|analysis|data|findings?)\b",
    r"\bthis\s+(?:shows?|demonstrates?|implies?|suggests?|confirms?|indicates?)\b",
    r"\bthe\s+(?:results?|data|measurements?|observations?)\s+(?:show|indicate|suggest|confirm|demonstrate)\b",
    r"\bis\s+consistent\s+with\b",
    r"\bwe\s+(?:can|cannot)\s+(?:rule|exclude|reject)\b",
    r"\bimplies?\s+that\b",
    r"\bprovides?\s+evidence\b",
    r"\bsignificant(?:ly)?\b",
    r"\bat\s+\d+(?:\.\d+)?[σ%]\b",
    r"\bp\s*[<>=]\s*0\.\d+\b",
    r"\bconfidence\s+(?:level|interval)\b",
    r"\b(?:the\s+)?model\s+(?:recovers?|predicts?|reproduces?|confirms?|validates?)\b",
    r"\b(?:accurately|correctly|successfully)\s+(?:recovers?|predicts?|reproduces?)\b",
]
# Signs of background.
BACKGROUND_SIGNS = [
    r"\bit\s+is\s+well\s+known\b",
    r"\bprevious(?:ly)?\s+(?:shown|demonstrated|established)\b",
    r"\baccording\s+to\b",
    r"\b(?:in|from)\s+(?:the\s+)?(?:literature|previous\s+work|earlier\s+studies)\b",
    r"\bstandard\s+model\b",
    r"\bclassical(?:ly)?\b",
    r"\bconventional(?:ly)?\b",
]
# Patterns of subject (1), relation (2) and object (3).
SRO = [
    r"(.+?)\s+(?:is|are)\s+(consistent\s+with|incompatible\s+with|in\s+agreement\s+with|in\s+tension\s+with)\s+(.+)",
    r"(.+?)\s+(confirms?|validates?|contradicts?|supports?|refutes?|challenges?|reproduces?|predicts?|violates?|exceeds?|rules?\s+out|corroborates?|recovers?|agrees?\s+with|disagrees?\s+with)\s+(.+)",
    r"[Ww]e\s+(?:find|show|demonstrate|measure|observe|conclude|report)\s+(?:that\s+)?(.+?)\s+(is|are|equals?|has|have|can|cannot|does|do|shows?)\s+(.+)",
    r"(.+?)\s+(implies?|suggests?|indicates?|demonstrates?|provides?\s+evidence\s+for)\s+(?:that\s+)?(.+)",
]
UNSTRUCTURED = "(unstructured — needs human review)"


def _p(pattern: str) -> Column:
    return F.lit("(?iU)" + pattern)


def _found(text: Column, patterns: list[str]) -> Column:
    hits = F.array(*[F.regexp_substr(text, _p(p)) for p in patterns])
    return F.filter(hits, lambda x: x.isNotNull())


def polarity(text: Column) -> Column:
    """negative if any negative marker is there (even beside positive ones), else positive, else neutral."""
    any_of = lambda ps: F.lit(False) if not ps else text.rlike("(?iU)" + "|".join(ps))
    return F.when(any_of(NEGATIVE), "negative").when(any_of(POSITIVE), "positive").otherwise("neutral")


def polarity_markers(text: Column) -> Column:
    """The first match of each marker, negative ones first."""
    return F.concat(_found(text, NEGATIVE), _found(text, POSITIVE))


def sentences(text: Column) -> Column:
    """Array of sentences: split after . ! ? before a capital, joined again after an abbreviation."""
    raw = F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])")
    last = lambda s: F.lower(F.element_at(F.split(F.trim(F.regexp_replace(s, r"[.!?]+$", "")), r"\s+"), -1))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, chunk: Column) -> Column:
        goes_on = F.array_contains(F.array(*[F.lit(a) for a in ABBREVIATIONS]), last(acc["now"]))
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), chunk.alias("now")))
            .when(goes_on, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(" "), chunk).alias("now")))
            .otherwise(F.struct(F.array_append(acc["done"], F.trim(acc["now"])).alias("done"), chunk.alias("now")))
        )

    return F.aggregate(raw, none, step, lambda a: F.when(F.trim(a["now"]) == "", a["done"]).otherwise(F.array_append(a["done"], F.regexp_replace(a["now"], r"(?U)^\s+|\s+$", ""))))


def _hits(text: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike("(?iU)" + p).cast("int")
    return out


def claim_confidence(text: Column) -> Column:
    """high for two signs of a claim, medium for one, low for one beside background, null for none."""
    claim, background = _hits(text, CLAIM_SIGNS), _hits(text, BACKGROUND_SIGNS)
    return F.when(claim >= 2, "high").when((claim == 1) & (background == 0), "medium").when(claim == 1, "low")


def sro(text: Column) -> Column:
    """struct(subject, relationship, object) of the first pattern whose sides have 3 characters; null without one.

    If either side is over 200 characters both are cut to 200.
    """
    found = []
    for p in SRO:
        part = lambda k, p=p: F.regexp_extract(text, "(?iU)" + p, k)
        s = F.regexp_replace(F.trim(part(1)), r"[,;:]+$", "")
        o = F.regexp_replace(F.trim(part(3)), r"[.,;:]+$", "")
        long = (F.length(s) > 200) | (F.length(o) > 200)
        cut = lambda x, long=long: F.when(long, F.substring(x, 1, 200)).otherwise(x)
        found.append(F.when((F.length(s) >= 3) & (F.length(o) >= 3), F.struct(cut(s).alias("subject"), F.trim(part(2)).alias("relationship"), cut(o).alias("object"))))
    return F.coalesce(*found)


def extract_claims(texts: DataFrame, text_col: str = "text", section_col: str | None = None, min_confidence: str = "low") -> DataFrame:
    """Claims of each row's sentences of 20 characters at least, all waiting for human approval.

    `min_confidence` is tested before a claim without subject and object is lowered to low.
    """
    order = {"low": 0, "medium": 1, "high": 2}
    keep = [c for c in texts.columns if c != text_col]
    rows = texts.filter(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(*keep, F.posexplode(sentences(F.col(text_col))).alias("position", "claim"))
    rows = rows.filter(F.length("claim") >= 20).withColumn("confidence", claim_confidence(F.col("claim"))).filter("confidence is not null")
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    rows = rows.filter(rank >= order[min_confidence]).withColumn("s", sro(F.col("claim")))
    none = F.col("s").isNull()
    return rows.select(
        *keep, "position", F.col("claim").alias("text"), F.when(none, F.substring("claim", 1, 80)).otherwise(F.col("s.subject")).alias("subject"),
        F.when(none, "claims").otherwise(F.col("s.relationship")).alias("relationship"), F.when(none, UNSTRUCTURED).otherwise(F.col("s.object")).alias("object"),
        F.when(none, "low").otherwise(F.col("confidence")).alias("confidence"), polarity(F.col("claim")).alias("polarity_hint"),
        polarity_markers(F.col("claim")).alias("polarity_markers"), (F.col(section_col) if section_col else F.lit("")).alias("source_section"), F.lit(False).alias("human_approved"),
    )


def extract_from_sections(papers: DataFrame, id_col: str = "id", sections_col: str = "sections", min_confidence: str = "low") -> DataFrame:
    """Claims of papers whose sections are a map of names to texts."""
    rows = papers.select(id_col, F.explode(sections_col).alias("section", "text"))
    return extract_claims(rows, "text", "section", min_confidence).drop("section")
