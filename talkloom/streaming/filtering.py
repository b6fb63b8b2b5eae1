"""New JSON-lines files through the stateless filters, once per record id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkloom.sources import jsonl


def filter_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, run: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Read files as they come, run the filters, and append to ``<sink>/passed`` and ``<sink>/failed``.

    ``run`` adds ``passed`` and the pipeline's columns. Ids that the sink holds
    are dropped by an anti-join with it, so files that are delivered twice
    change nothing and the stream keeps no state; a batch that is replayed
    after a failure overwrites its own folder, which it leaves out of the join.
    """
    lines = spark.readStream.format("text").load(source).select(F.lit("").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    records = jsonl.parsed(lines).where("record is not null").select("record.*").where("id is not null")

    def write(batch: DataFrame, number: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.parquet(sink).where(F.col("batch") != number).select("id")
            batch = batch.join(known, "id", "left_anti")
        done = run(batch.dropDuplicates(["id"])).withColumn("state", F.when(F.col("passed"), "passed").otherwise("failed"))
        done.write.mode("overwrite").partitionBy("state").parquet(f"{sink}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
