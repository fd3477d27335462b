"""Scratch storage that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own (local masters only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cohera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: no lineage, partitions kept as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read it back (columnar, with true sizes)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(df: DataFrame) -> bool:
    """Whether the rows come straight, each once, from Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def placed(df: DataFrame) -> DataFrame:
    """`df` with `_at`, its file and its number in it: it tells rows apart and stays the same when work is redone.

    Rows that don't come straight from Parquet files are written to the shared folder first. A column named `_at`
    is replaced.
    """
    rows = df if _stored(df) else written(df, "rows")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("_at", place)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 8, how: str = "left") -> DataFrame:
    """Join `rows` to the one-row-per-key `table` so that one hot key is dealt over `salts` tasks.

    `spread` is a column of `rows` by whose hash a hot key is split; `table` is repeated once for each salt.
    Spark may still broadcast a small table, or split what stays uneven.
    """
    salt = "_salt"
    while salt in rows.columns or salt in table.columns:
        salt += "_"
    salted = rows.withColumn(salt, F.pmod(F.hash(F.col(f"`{spread}`")), F.lit(salts)))
    dealt = table.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(dealt, [key, salt], how).drop(salt)
