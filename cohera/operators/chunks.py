"""Text chunks of a knowledge base, and the texts that entries are embedded by."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections that an entry's embedding text takes, in order; entries that are stubs.
EMBED_SECTIONS = ["What It Claims", "What It Captures", "What The Math Says", "Mathematical Form", "Notes"]
STUBS = ("thm_ObviousConstruction", "thm_ProtocolSimulation")
MIN_CHARS = 50
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def extract_chunks(entries: DataFrame, sections: DataFrame, conjectures: DataFrame | None = None, gates: DataFrame | None = None, bridge_content: DataFrame | None = None) -> DataFrame:
    """(chunk_id, entry_id, chunk_type, title, section_name, embed_text, metadata map) of the four sources.

    Empty contents are left out; of a reference law the cross-references are left out and only the first paragraph of
    its mathematical archetype is taken.
    """
    meta = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    law = _s("entry_type") == "reference_law"
    content = F.trim(_s("content"))
    j = entries.join(sections, entries["id"] == sections["entry_id"]).filter(~(law & (F.col("section_name") == "DS Cross-References")))
    j = j.withColumn("content", F.when(law & (F.col("section_name") == "Mathematical Archetype"), F.trim(F.split(content, "\n\n")[0])).otherwise(content)).filter("content <> ''")
    info = {k: (_s(k) if k in entries.columns else F.lit("")) for k in ("entry_type", "scale", "domain", "status", "confidence", "type_group")}
    out = j.select(
        F.concat("id", F.lit("_"), slug(F.col("section_name"))).alias("chunk_id"), "entry_id", F.lit("section").alias("chunk_type"), "title", "section_name",
        F.concat("title", F.lit("\n["), "section_name", F.lit("]\n"), "content").alias("embed_text"), meta(entry_id=F.col("entry_id"), chunk_type=F.lit("section"), section_name=F.col("section_name"), **info).alias("metadata"),
    )
    line = lambda label, c: F.when(_s(c) != "", F.concat(F.lit(f"{label}: "), c))
    if conjectures is not None:
        i, t = F.concat(F.lit("conj_"), "id"), F.concat(F.lit("Conjecture "), "id", F.lit(": "), "title")
        text = F.concat_ws("\n", t, line("Claim", "claim"), line("Would confirm", "would_confirm"), line("Would kill", "would_kill"), line("Critical gaps", "critical_gaps"))
        out = out.unionByName(conjectures.select(i.alias("chunk_id"), i.alias("entry_id"), F.lit("conjecture").alias("chunk_type"), t.alias("title"), F.lit("conjecture").alias("section_name"), text.alias("embed_text"),
                                                 meta(entry_id=i, chunk_type=F.lit("conjecture"), section_name=F.lit("conjecture"), gate=_s("gate"), entry_type=F.lit("conjecture"), status=F.lit("conjectured"), type_group=F.lit("P")).alias("metadata")))
    if gates is not None:
        i, t = F.concat(F.lit("gate_"), "id"), F.concat(F.lit("Gate "), "id")
        text = F.concat_ws("\n", t, line("Claim", "claim"), line("Priority", "priority"), line("Blocking", "blocking"))
        out = out.unionByName(gates.select(i.alias("chunk_id"), i.alias("entry_id"), F.lit("gate").alias("chunk_type"), t.alias("title"), F.lit("gate").alias("section_name"), text.alias("embed_text"),
                                           meta(entry_id=i, chunk_type=F.lit("gate"), section_name=F.lit("gate"), priority=_s("priority"), entry_type=F.lit("gate"), type_group=F.lit("G")).alias("metadata")))
    if bridge_content is not None:
        b = bridge_content.withColumn("content", F.trim(_s("content"))).filter("content <> ''")
        out = out.unionByName(b.select(F.concat(F.lit("bridge_"), slug(F.col("section_name"))).alias("chunk_id"), F.lit("bridge").alias("entry_id"), F.lit("bridge").alias("chunk_type"),
                                       F.concat(F.lit("Bridge: "), "section_name").alias("title"), "section_name", F.concat(F.lit("[Bridge: "), "section_name", F.lit("]\n"), "content").alias("embed_text"),
                                       meta(entry_id=F.lit("bridge"), chunk_type=F.lit("bridge"), section_name=F.col("section_name"), entry_type=F.lit("bridge"), type_group=F.lit("bridge")).alias("metadata")))
    return out


def embed_texts(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, text): type and title, then the wanted sections in order; stubs and entries of under 50 characters stay out."""
    body = F.trim(_s("content"))
    body = F.when(body.contains("\n\n") & body.startswith("[Supplemental"), F.trim(F.regexp_replace(body, r"(?s)^.*?\n\n", ""))).otherwise(body)
    order = F.array_position(F.array(*[F.lit(s) for s in EMBED_SECTIONS]), F.col("section_name"))
    per = sections.groupBy("entry_id").agg(
        F.sum(F.length(_s("content"))).alias("chars"),
        F.transform(F.array_sort(F.collect_list(F.when(order > 0, F.struct(order.alias("o"), body.alias("b"))))), lambda x: x["b"]).alias("parts"),
    )
    j = entries.join(per, entries["id"] == per["entry_id"]).filter(~F.col("id").isin(*STUBS) & (F.col("chars") >= MIN_CHARS))
    parts = F.filter("parts", lambda x: x != "")
    return j.select("id", F.concat_ws(" ", F.concat(_s("entry_type"), F.lit(": "), _s("title")), parts).alias("text"))


def hashed_encoder(dim: int = 256):
    """A stand-in encoder where no model is at hand: signed hashed word counts at unit length, as a pandas UDF."""
    import zlib

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return encode


def embed(rows: DataFrame, encoder=None, text_col: str = "text", query: bool = False) -> DataFrame:
    """`rows` with vec, from any UDF of texts to vectors; queries get the retrieval prefix."""
    text = F.concat(F.lit(QUERY_PREFIX), F.col(text_col)) if query else F.col(text_col)
    return rows.withColumn("vec", (encoder or hashed_encoder())(text))


def excerpt(sections: DataFrame, order: list[str], most: int = 120) -> DataFrame:
    """(entry_id, excerpt): the first section by the given order of names (others after), newlines as spaces, cut at 120."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section_name"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    best = sections.groupBy("entry_id").agg(F.min_by("content", F.struct(rank, F.col("section_order"))).alias("c"))
    flat = F.regexp_replace("c", "\n", " ")
    return best.select("entry_id", F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat).alias("excerpt"))
