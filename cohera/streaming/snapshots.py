"""Our own addition: snapshots that arrive as files are compared with what came before, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohera.operators.snapshots import drift
from cohera.schemas import HISTORY


def watch_snapshots(spark: SparkSession, incoming: str, latest: str, out: str, checkpoint: str):
    """Start a query: each batch of history files in `incoming` is compared with the vectors in `latest`; drift rows are
    written to `out`, and the batch's newest vectors to `latest`, both under the batch's number: a batch that is run
    again replaces what it wrote. Returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        new = batch.groupBy("chunk_id").agg(F.max_by("embedding", "snapshot_id").alias("embedding"))
        try:
            old = spark.read.parquet(latest).filter(F.col("batch") < number).groupBy("chunk_id").agg(F.max_by("embedding", "batch").alias("embedding"))
        except AnalysisException:
            old = new.limit(0)
        drift(old, new).write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.write.mode("overwrite").parquet(f"{latest}/batch={number}")

    stream = spark.readStream.schema(HISTORY).parquet(incoming)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
