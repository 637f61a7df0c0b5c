"""Where finished streams leave their rows: Parquet in the folder all executors share, never the driver's memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/jumpmark-streams"
    return f"{found.rstrip('/')}/jumpmark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, complete: bool = False) -> DataFrame:
    """Run a stream over all it has now and read what it wrote.

    Appended rows go to a file sink, which has each of them once though a batch may run again. Complete results are written
    by batch (each batch's folder over its own, so a repeated batch changes nothing) and the last batch counts.
    """
    spark = stream.sparkSession
    base = shared_dir(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if not complete:
        writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{number}")
        last.append(number)

    writer.outputMode("complete").foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/{max(last)}")
