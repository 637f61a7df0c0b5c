"""Structured Streaming forms of the counting windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of one Parquet file, or of all files of a folder.

    The last letter stands as a pattern: of a plain path Spark takes only a folder, and of a folder above none of the parts in it.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: With this lead, windows that begin on even seconds hold the times whose nearest second they hold, as SQL that casts an epoch to BIGINT does.
NEAREST = "500 milliseconds"


def ahead(events: DataFrame, lead: str) -> DataFrame:
    """Events with ts moved on by lead."""
    return events.withColumn("ts", F.col("ts").cast("timestamp") + F.expr(f"INTERVAL '{lead}'"))


def tumbling(events: DataFrame, size: str, watermark: str | None = None, lead: str = "0 seconds") -> DataFrame:
    """Counts and sums by window of times moved on by lead; the watermark stays so far behind the times themselves."""
    e = ahead(events, lead)
    e = e.withWatermark("ts", f"{watermark} {lead}") if watermark else e
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sliding(events: DataFrame, size: str, slide: str, lead: str = "0 seconds") -> DataFrame:
    """Counts by sliding window of times moved on by lead."""
    return ahead(events, lead).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))


def jumps(events: DataFrame, key: str = "user_id") -> DataFrame:
    """On a stream: a row whenever a key's state differs from its last one. The last state is kept per key."""
    import pandas as pd

    def step(k, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if last is not None and kind != last:
                out.append((k[0], event, last, kind))
            last = kind
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", "before", "after"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, before string, after string", "last string", "append", "NoTimeout")


def late(events: DataFrame, size: str, watermark: str, lead: str = "0 seconds") -> DataFrame:
    """Counts by window that a watermark closes: a window is given out once, when it is over; what comes later is left out."""
    return tumbling(events, size, watermark, lead)


def heat_map(events: DataFrame, size: str, rows: int, columns: int, lead: str = "0 seconds") -> DataFrame:
    """Events a window (of times moved on by lead) by place (by, bx) of a grid of users."""
    e = ahead(events, lead)
    place = [(F.col("user_id") % rows).cast("int").alias("by"), (F.floor(F.col("user_id") / rows) % columns).cast("int").alias("bx")]
    return e.groupBy(F.window("ts", size), *place).agg(F.count("*").alias("n"))


def pushed(events: DataFrame, least: float, key: str = "user_id") -> DataFrame:
    """Jumps (as jumps()) of events of at least some magnitude; smaller ones neither count nor change a key's state."""
    return jumps(events.where(F.col("value") >= least), key)


def by_chunk(events: DataFrame, path: str) -> None:
    """Counts of each chunk of a stream, added to a table of partial counts by chunk number; a chunk that runs again replaces its own part."""

    def add(chunk: DataFrame, number: int) -> None:
        chunk.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).write.mode("overwrite").parquet(f"{path}/rows/chunk={number}")

    events.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(add).start().awaitTermination()
