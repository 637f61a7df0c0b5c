"""Joins the domain needs beyond equality on a key, each by an equality on derived keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def interval(points: DataFrame, tags: DataFrame, key: str, t: str, bucket: int) -> DataFrame:
    """Points within [t0, t1] of a tag: tags are spread over time buckets, so the join is an equi join."""
    spread = tags.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    p = points.withColumn("bucket", F.floor(F.col(t) / bucket))
    return p.join(spread, [key, "bucket"]).where(F.col(t).between(F.col("t0"), F.col("t1"))).drop("bucket")


def covering_block(cells: DataFrame, size: int, frames: int, per_row: int, per_frame: int) -> DataFrame:
    """The number of the block that covers a cell, by integer division."""
    return cells.withColumn("block_no", (F.floor(F.col("t") / frames) * per_frame + F.floor(F.col("y") / size) * per_row + F.floor(F.col("x") / size)).cast("long"))


def deltas(new: DataFrame, ref: DataFrame) -> DataFrame:
    """Per video: differences to the reference; a missing reference has 8 bits a pixel and ratio 1."""
    j = new.alias("a").join(ref.alias("b"), F.col("a.video") == F.col("b.video"), "left")
    base = F.coalesce("b.ratio", F.lit(1.0))
    return j.select(F.col("a.video").alias("video"), (F.coalesce("b.bpp", F.lit(8.0)) - F.col("a.bpp")).alias("bpp_delta"), (F.col("a.ratio") / F.greatest(base, F.lit(0.01)) - 1).alias("ratio_delta"))


def judge(d: DataFrame) -> DataFrame:
    """One row: means, spread, confidence, regressions (worse by over 1 %) and the recommendation."""
    g = d.agg(F.count("*").alias("n"), F.avg("bpp_delta").alias("bpp"), F.avg("ratio_delta").alias("ratio"), F.stddev_pop("ratio_delta").alias("std"), F.count_if(F.col("ratio_delta") < -0.01).alias("regressions"))
    ok = (F.col("ratio") > 0.001) & (F.col("regressions") == 0)
    return g.withColumns({"confidence": F.greatest(F.lit(0.0), 1 - F.col("std") / F.greatest(F.abs("ratio"), F.lit(0.001))), "recommendation": F.when(ok, "accept").otherwise("reject")})


def pyramid(spark: SparkSession, levels: int, static_every: int, lod: int) -> DataFrame:
    """Nodes reached when descending to a level and not below static ones (recursive query over a quadtree by arithmetic)."""
    return spark.sql(f"""
        WITH RECURSIVE d(level, node) AS (
            SELECT 0, CAST(0 AS BIGINT)
            UNION ALL
            SELECT level + 1, node * 4 + k FROM d, (SELECT explode(sequence(0, 3)) AS k) WHERE level < {min(levels, lod)} AND NOT (level > 0 AND node % {static_every} = 0))
        SELECT level, count(*) AS n, sum(node) AS s, count_if(level > 0 AND node % {static_every} = 0) AS n_static FROM d GROUP BY level""")
