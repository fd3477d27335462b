"""A training-data pipeline: toxicity, quality rules, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of `docs`. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.llm import decontam, packing, quality, simhash, toxicity
from cohera.plans.shared import placed, written


def _wrapped(docs: DataFrame) -> DataFrame:
    """(row, text): all columns as one, so that an operator's new columns can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the model learns from the labelled ones among `docs`."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_wrapped(docs), model).filter(F.col("score") < toxicity.LIMIT).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves and whose host isn't rejected."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (null ids last; of equal ids the first row).

    Texts are linked by the trie join of their fingerprints over two words, within 8 bits, if their wide fingerprints
    over five words are as near as those of texts of similarity 0.78: the estimate's error of 0.025 below 0.8.
    """
    rows = placed(docs)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_at"))
    groups = simhash.near_duplicates(rows.select(own.alias("id"), "text"), id_col="id", shingle_words=2, budget=8, wide_words=5, similarity=0.78)
    lost = written(groups.filter("id <> component_id").select(F.col("id._at").alias("_at")), "copies")
    return rows.join(lost, "_at", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = placed(docs)
    index = decontam.build_index(rows.select("_at", "text"))
    hit = written(decontam.phrase_hits(index, bench).select("_at"), "hit")
    return rows.join(hit, "_at", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of the permitted lengths."""
    return packing.pack(packing.with_lengths(docs.select("doc_id", "text")).select("doc_id", "n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_documents),
]

#: A trained classifier and fingerprint links can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = written(out, f"stage{k}")
    return docs
