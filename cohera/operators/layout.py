"""Page text: running heads, sections, garbled formulas, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Numbered headings (text in group 1) and headings in capitals.
NUMBERED = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+|[IVXLC]+\.\s+)([A-Z][A-Za-z ,&\-:]+)", re.M)
CAPITALS = re.compile(r"^([A-Z]{2}[A-Z ,&\-:]{1,50})$", re.M)
NO_HEADING = ("fig", "table", "eq.", "equation")
# What is left where a formula was lost, and signs that one is still there.
GHOSTS = [
    re.compile(r"(?:^|\.\s+)(?:where|such that|given that|letting|for)\s*$", re.M),
    re.compile(r"^\s*[=<>≤≥≈∝±]+\s*$", re.M),
    re.compile(r"\(\s*\)"),
    re.compile(r"(?:Eq(?:uation)?\.?\s*\(?(\d+)\)?)", re.I),
    re.compile(r"(?:is|becomes|yields|equals|gives|reads)\s*[,.]?\s*$", re.M),
    re.compile(r"^\s*(?:dB|μm|nm|keV|MeV|GeV|eV|Hz|GHz|MHz|cm|mm|W|mW|nW)\s*$", re.M),
]
SYMBOLS = "αβγδεζηθλμνξπρσφψωΔΩΣ∫∑∏√≈≤≥±∝∞ℏħ∂∇"


def edge_lines(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, line): distinct trimmed lines of 5 to 120 characters among a page's first and last three."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    few = F.when(F.size("l") > 6, F.concat(F.slice("l", 1, 3), F.slice("l", -3, 3))).otherwise(F.col("l"))
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), lines.alias("l")).select("doc", "page", F.explode(few).alias("line"))
    return rows.withColumn("line", F.trim("line")).filter(F.length("line").between(5, 120)).distinct()


def running_heads(pages: DataFrame, doc: str, page: str, text: str = "text", threshold: int = 3) -> DataFrame:
    """(doc, line, n_pages): edge lines on at least min(threshold, max(2, pages // 3)) pages of their document."""
    need = pages.groupBy(F.col(doc).alias("doc")).agg(F.least(F.lit(threshold), F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 3))).alias("need"))
    counts = edge_lines(pages, doc, page, text).groupBy("doc", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(need, "doc").filter(F.col("n_pages") >= F.col("need")).drop("need")


def strip_running_heads(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, text) without their document's running heads, wherever they stand."""
    heads = running_heads(pages, doc, page, text).groupBy("doc").agg(F.collect_set("line").alias("heads"))
    j = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text")).join(heads, "doc", "left")
    none = F.array().cast("array<string>")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("heads", none), F.trim(x)))
    return j.select("doc", "page", F.array_join(kept, "\n").alias("text"))


def full_text(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, text): a document's stripped pages in order, a blank line between them."""
    p = strip_running_heads(pages, doc, page, text)
    pages_in_order = F.array_sort(F.collect_list(F.struct("page", "text")))
    return p.groupBy("doc").agg(F.array_join(F.transform(pages_in_order, lambda x: x["text"]), "\n\n").alias("text"))


def sections_of(text: str | None) -> list[tuple[str, str]]:
    """(name, content) between headings; text before the first of over 50 characters is the preamble."""
    if not text or not text.strip():
        return []
    heads = sorted(
        ((m.start(), name) for pattern in (NUMBERED, CAPITALS) for m in pattern.finditer(text)
         if 3 <= len(name := m.group(1).strip()) <= 60 and not name.lower().startswith(NO_HEADING)),
        key=lambda h: h[0],
    )
    if not heads:
        return [("full_text", text.strip())]
    kept = heads[:1]
    for h in heads[1:]:
        if h[0] - kept[-1][0] >= 20:
            kept.append(h)
    out: dict[str, str] = {}
    before = text[: kept[0][0]].strip()
    if len(before) > 50:
        out["preamble"] = before
    bounds = [p for p, _ in kept[1:]] + [len(text)]
    for (start, name), end in zip(kept, bounds, strict=True):
        line_end = text.find("\n", start)
        content = text[line_end if line_end >= 0 else start + len(name) : end].strip()
        if content:
            names = [name, *(f"{name} ({k})" for k in range(2, len(out) + 3))]
            out[next(k for k in names if k not in out)] = content
    return list(out.items())


def formula_flags(text: str | None) -> list[tuple[int, str, str]]:
    """(line, kind, pattern) of places with a lost (ghost) or surviving formula; within three lines of the last kept one
    only a ghost replaces a survivor."""
    if not text:
        return []
    found = [(text.count("\n", 0, m.start()) + 1, "ghost", m.group().strip() or p.pattern[:50]) for p in GHOSTS for m in p.finditer(text)]
    for i, line in enumerate(text.split("\n"), 1):
        if signs := sorted({c for c in line if c in SYMBOLS}):
            found.append((i, "survivor", "symbols: " + "".join(signs)))
    kept: list[tuple[int, str, str]] = []
    for f in sorted(found, key=lambda x: x[0]):
        if not kept or f[0] - kept[-1][0] >= 3:
            kept.append(f)
        elif f[1] == "ghost" and kept[-1][1] == "survivor":
            kept[-1] = f
    return kept


def segment_sections(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, section_order, section_name, content) of each document, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, name, body) for i, t in zip(pdf.id, pdf.text, strict=True) for k, (name, body) in enumerate(sections_of(t))]
            yield pd.DataFrame(rows, columns=["id", "section_order", "section_name", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, section_order int, section_name string, content string")


def math_regions(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_number, detection_type, pattern_matched) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, *f) for i, t in zip(pdf.id, pdf.text, strict=True) for f in formula_flags(t)]
            yield pd.DataFrame(rows, columns=["id", "line_number", "detection_type", "pattern_matched"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, line_number int, detection_type string, pattern_matched string")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: at blank lines, and where a line that ends a sentence meets one that starts with a capital;
    lines are joined, and what has under 30 characters joins the paragraph before."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    chunks = F.transform(F.split(text, r"\n\s*\n"), trimmed)
    subs = F.flatten(F.transform(chunks, lambda c: F.split(c, "(?<=[.?!:»”])\n(?=[A-Z\\[\\(])")))
    clean = F.filter(F.transform(subs, lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), r"(?<!\n)\n(?!\n)", " "), "  +", " ")), lambda x: x != "")
    last = lambda a: F.element_at(a, -1)

    def step(acc: Column, x: Column) -> Column:
        short = (F.length(x) < 30) & (F.size(acc) > 0)
        return F.when(short, F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last(acc), F.lit("\n"), x))).otherwise(F.array_append(acc, x))

    return F.aggregate(clean, F.array().cast("array<string>"), step)


def assemble_groups(paras: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, label, text) of paragraphs (doc, position, text) under groups (doc, label, paragraphs array of positions).

    Of a document whose groups name a position that doesn't exist, or one twice, nothing is returned.
    """
    named = groups.select("doc", "label", F.explode("paragraphs").alias("position"))
    j = named.join(paras, ["doc", "position"], "left")
    twice = F.count(F.lit(1)).over(Window.partitionBy("doc", "position")) > 1
    bad = j.withColumn("bad", F.col("text").isNull() | twice).groupBy("doc").agg(F.bool_or("bad").alias("bad")).filter("bad")
    ok = j.join(bad, "doc", "left_anti")
    return ok.groupBy("doc", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def extract_to_claims(docs: DataFrame, id_col: str, text_col: str = "text", min_confidence: str = "low") -> DataFrame:
    """Claims of every section of each document."""
    from cohera.operators.claims import extract_claims

    return extract_claims(segment_sections(docs, id_col, text_col).select("id", "section_name", F.col("content").alias("text")), "text", "section_name", min_confidence)
