"""Views of the driver's tables as point processes, dense grids, benchmark runs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bins of 8 hours over 30 days.
HOURS, R = 8, 90


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_marks(df: DataFrame, column: str) -> DataFrame:
    """df with mark: the rank of column's value among its distinct values (the alphabet, ranked on its own small table)."""
    alphabet = df.select(column).distinct().withColumn("mark", F.row_number().over(W.orderBy(column)) - 1)
    return df.join(alphabet, column)


def pp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps (block_id: user, seq, t: 8-hour bin, mark: event type, ts, value)."""
    e = dense_marks(table(spark, sf_dir, "events"), "event_type")
    t = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) div {HOURS}")
    return e.select(F.col("user_id").alias("block_id"), F.col("event_id").alias("seq"), t.cast("int").alias("t"), "mark", "ts", "value", "event_type")


#: Vectors in a row that make a block of a label; the blocks grow in number with the table.
GOP = 256


def _block() -> Column:
    return (F.floor(F.col("vec_id") / GOP) * 10 + F.col("label")).cast("long").alias("block")


def grid_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (block: label in a run of GOP vectors, t: vec_id, x: position, c: quantised component, v)."""
    e = table(spark, sf_dir, "embeddings").select(_block(), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("x", "v"))
    c = F.least(F.greatest(F.floor((F.col("v").cast("double") + 0.5) * 16), F.lit(0)), F.lit(15))
    return e.select("block", "t", "x", c.cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (block: label in a run of GOP vectors, t: vec_id, y, x: place in a frame of 8 x 8, c: quantised component)."""
    e = table(spark, sf_dir, "embeddings").select(_block(), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "v"))
    c = F.least(F.greatest(F.floor((F.col("v").cast("double") + 0.5) * 16), F.lit(0)), F.lit(15))
    return e.select("block", "t", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), c.cast("int").alias("c"))


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark facts: video (nation), codec (priority), quality_param (status) with sizes and quality numbers."""
    o, c, n, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "lineitem"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_name").alias("video"), F.col("o_orderpriority").alias("codec"), F.col("o_orderstatus").alias("quality_param"))
    # sums in whole cents and integer division: the same on any engine and in any order
    cents = lambda e: F.sum(F.round(F.expr(e) * 100).cast("long"))
    sums = {"i": "l_extendedprice", "o": "l_extendedprice * l_discount", "q": "l_quantity", "t": "l_tax"}
    g = g.agg(*(cents(e).alias(k) for k, e in sums.items()), F.count("*").alias("n_frames"))
    share = lambda k: F.expr(f"({k} * 100) div n_frames") / 10000
    return g.select(
        "video", "codec", "quality_param", (F.col("i") / 100).alias("input_size"), (F.col("o") / 100 + 1).alias("output_size"),
        share("i").alias("bitrate"), share("q").alias("psnr"), (1 - share("t")).alias("ssim"), "n_frames",
    )


def block_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: actual and predicted classes on three dimensions and two costs, per labelled document."""
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(d, "doc_id")
    return j.select(
        F.col("doc_id").alias("block_id"), F.col("quality").alias("act_a"), (1 - F.col("toxic")).alias("pred_a"), (F.col("n_chars") % 4).cast("int").alias("act_b"), (F.col("doc_id") % 4).cast("int").alias("pred_b"),
        F.least(F.floor(F.col("n_chars") / 1000), F.lit(4)).cast("int").alias("act_c"), F.least(F.floor(F.col("n_chars") / 1200), F.lit(4)).cast("int").alias("pred_c"),
        F.col("n_chars").cast("double").alias("optimal_cost"), (F.col("n_chars") + F.col("doc_id") % 97).cast("double").alias("predicted_cost"),
    )
