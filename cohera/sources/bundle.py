"""Bundles as folders of Parquet tables: create, open with migration, meta, idempotent and replacing writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from cohera.plans.shared import cut
from cohera.schemas import BUNDLE, DEFAULTS, META, SCHEMA_VERSION, conform

#: Columns that tell rows of a table apart; links have none.
UNIQUE = {"entries": ["id"], "sections": ["entry_id", "section_name"], "entry_properties": ["entry_id", "property_name"], "rrp_meta": ["key"]}
FISHER_KEY = ["entry_id", "graph_source", "kernel_type", "alpha"]


def create_bundle(spark: SparkSession, path: str, name: str, source: str, fmt: str) -> None:
    """Empty typed tables, and five meta rows."""
    for table, schema in BUNDLE.items():
        if table != "rrp_meta":
            spark.createDataFrame([], T.StructType.fromDDL(schema)).write.mode("overwrite").parquet(f"{path}/{table}")
    now = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    rows = [("package_name", name), ("source", source), ("format", fmt), ("created_at", now), ("schema_version", SCHEMA_VERSION)]
    spark.createDataFrame(rows, META).coalesce(1).write.mode("overwrite").parquet(f"{path}/rrp_meta")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table in its present schema: columns, or a whole table, that an older bundle lacks are added."""
    schema = BUNDLE[table]
    try:
        found = spark.read.option("mergeSchema", "true").parquet(f"{path}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return conform(found, schema, DEFAULTS.get(table))


def read_bridges(spark: SparkSession, path: str) -> DataFrame:
    """The bridges of a bundle; an error where it has no such table (a graph over both sides would lack its middle)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cross_universe_bridges")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"{path} has no cross_universe_bridges: bridge it first")
    return read_table(spark, path, "cross_universe_bridges")


def open_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, path, t) for t in BUNDLE}


def get_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """The meta rows as a dictionary (a handful of keys)."""
    m = read_table(spark, path, "rrp_meta").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")).first()
    return dict(m["m"] or {})


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def insert_or_ignore(spark: SparkSession, path: str, table: str, rows: DataFrame) -> int:
    """Append rows whose unique key isn't there yet (of each key the first row); links are always appended. Rows added."""
    rows = conform(rows, BUNDLE[table], DEFAULTS.get(table))
    keys = UNIQUE.get(table)
    if keys:
        old = read_table(spark, path, table).select(*keys)
        numbered = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
        rows = first_of(numbered, keys, ["_at"]).drop("_at").join(old, keys, "left_anti")
    rows = cut(rows)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(f"{path}/{table}")
    return n


def replace_table(spark: SparkSession, path: str, table: str, rows: DataFrame) -> None:
    """Overwrite a table (bridges on each run): the rows are cut off first, so they may come from the table itself."""
    cut(conform(rows, BUNDLE[table], DEFAULTS.get(table))).write.mode("overwrite").parquet(f"{path}/{table}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = FISHER_KEY, newest: str = "computed_at") -> DataFrame:
    """Old and new rows, of each key the newest."""
    return first_of(old.unionByName(new, allowMissingColumns=True), keys, [F.desc(newest)])


def fisher_rows(swept: DataFrame, snapshot: str, source: str) -> DataFrame:
    """A sweep as rows of fisher_metrics; metrics are null where a node was skipped."""
    ok = lambda c: F.when(~F.col("skipped"), F.col(c))
    return swept.select(
        F.lit(snapshot).alias("snapshot_id"), "entry_id", F.lit(source).alias("graph_source"), "kernel_type", "alpha", ok("d_eff").alias("d_eff"),
        ok("participation_ratio").alias("participation_ratio"), ok("disorder_index").alias("disorder_index"), "regime", "sv_profile", "raw_sigmas",
        "center_degree", "n_vertices", "skipped", "skip_reason", F.current_timestamp().alias("computed_at"),
    )


def append_snapshot(snapshot: DataFrame, history: DataFrame, path: str) -> None:
    """Append a snapshot's rows; history is stored by snapshot and never rewritten."""
    history.write.mode("append").partitionBy("snapshot_id").parquet(f"{path}/chunk_embedding_history")
    snapshot.write.mode("append").parquet(f"{path}/wiki_snapshots")


def rebuild_index(vectors: DataFrame, path: str) -> None:
    """The vector table anew."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def insert_classified(spark: SparkSession, path: str, classified: DataFrame, least: float = 0.5, dry_run: bool = False) -> dict[str, int]:
    """Insert classified links (source_id, target_id, link_type, confidence): not those of no type, of low confidence or
    between linked entries; counts by outcome."""
    links = read_table(spark, path, "links")
    known = links.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().withColumn("there", F.lit(True))
    j = classified.join(known, (F.least("source_id", "target_id") == F.col("a")) & (F.greatest("source_id", "target_id") == F.col("b")), "left")
    outcome = F.when(F.coalesce("link_type", F.lit("no link")) == "no link", "no_link").when(F.col("confidence") < least, "low_confidence").when(F.col("there"), "existing").otherwise("inserted")
    j = cut(j.withColumn("outcome", outcome).drop("a", "b", "there"))
    counts = {r["outcome"]: r["count"] for r in j.groupBy("outcome").count().collect()}
    if not dry_run and counts.get("inserted"):
        insert_or_ignore(spark, path, "links", j.filter("outcome = 'inserted'"))
    return counts


def backup(spark: SparkSession, path: str, to: str) -> str:
    """Copy a bundle's folder next to itself under a time stamp, through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{to}/backup_{stamp}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return f"{to}/backup_{stamp}"
