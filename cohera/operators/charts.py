"""Data frames behind the charts: histogram, heatmap, network layout, entry metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators.graph import degrees


def edge_width(sim: Column) -> Column:
    return F.when(sim >= 0.88, 3).when(sim >= 0.83, 2).otherwise(1)


def histogram(rows: DataFrame, value: str, by: str, lo: float = 0.74, hi: float = 0.91, width: float = 0.005) -> DataFrame:
    """(by, bin, n): half-open bins from lo to hi, the last one closed; values outside are left out."""
    n = round((hi - lo) / width)
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(n - 1)).cast("long")
    ok = rows.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    return ok.groupBy(F.col(by).alias("by"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def heatmap(rows: DataFrame, row: str, column: str, least: int = 5) -> DataFrame:
    """(row, column, n, column_total): columns of under 5 in all become Other."""
    totals = Window.partitionBy(column)
    c = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(totals))
    c = c.withColumn("c", F.when(F.col("t") < least, "Other").otherwise(F.col(column).cast("string")))
    out = c.groupBy(F.col(row).alias("row"), F.col("c").alias("column")).agg(F.sum("n").alias("n"))
    return out.withColumn("column_total", F.sum("n").over(Window.partitionBy("column")))


def bipartite_layout(bridges: DataFrame) -> DataFrame:
    """(side, id, y): KB entries by rank of their bridges, bundle entries at the mean of their KB entries."""
    counts = bridges.groupBy("ds_entry_id").agg(F.count(F.lit(1)).alias("n"))
    kb = counts.withColumn("y", F.row_number().over(Window.orderBy(F.desc("n"), "ds_entry_id")).cast("double") - 1)
    own = bridges.join(kb.select("ds_entry_id", "y"), "ds_entry_id").groupBy("rrp_entry_id").agg(F.avg("y").alias("y"))
    return kb.select(F.lit("kb").alias("side"), F.col("ds_entry_id").alias("id"), "y").unionByName(own.select(F.lit("bundle").alias("side"), F.col("rrp_entry_id").alias("id"), "y"))


def entry_metrics(entries: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(id, title, degree): the most connected entries."""
    return degrees(entries, edges).join(entries.select("id", "title"), "id").orderBy(F.desc("degree"), "id").limit(most).select("id", "title", "degree")


def bridge_stats(bridges: DataFrame) -> DataFrame:
    return bridges.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence_tier") == "1.5").alias("tier_1_5"), F.avg("similarity").alias("mean_sim"), F.median("similarity").alias("median_sim"))
