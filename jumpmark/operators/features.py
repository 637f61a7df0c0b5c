"""Block features: counts, entropy, regularity, spatial homogeneity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def mark_counts(events: DataFrame, block: str = "block_id") -> DataFrame:
    return events.groupBy(block, "mark").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, block: str = "block_id") -> DataFrame:
    """N, m_seen, H (bits) and effective colours from counts per class; one aggregation, no window."""
    n = F.sum("n")
    g = counts.groupBy(block).agg(n.alias("N"), F.count("*").alias("m_seen"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("H"), F.collect_list("n").alias("c"))
    return g.withColumn("m_eff", F.size(F.filter("c", lambda x: x >= F.greatest(F.lit(2.0), 0.01 * F.col("N"))))).drop("c")


def sequence_features(events: DataFrame, block: str = "block_id") -> DataFrame:
    """N_trans (adjacent differing marks) and R_temp (squared mean over variance of the gaps; 1 if undefined)."""
    w = W.partitionBy(block).orderBy("t", "seq")
    e = events.select(block, (F.col("mark") != F.lag("mark").over(w)).cast("int").alias("tr"), (F.col("t") - F.lag("t").over(w)).alias("gap"))
    g = e.groupBy(block).agg(F.coalesce(F.sum("tr"), F.lit(0)).alias("n_trans"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"))
    return g.withColumn("R_temp", F.when(F.col("var_gap") > 0, F.pow("mean_gap", F.lit(2)) / F.col("var_gap")).otherwise(1.0))


def block_features(events: DataFrame, r: int, block: str = "block_id") -> DataFrame:
    """One row per block: N, r, m (marks that occur), H, m_eff, n_trans, R_temp. Both halves group by block, so they join on one partitioning."""
    return entropy(mark_counts(events, block), block).join(sequence_features(events, block), block).select(block, "N", F.lit(r).alias("r"), F.col("m_seen").cast("int").alias("m"), "H", "m_eff", "n_trans", "R_temp")


def spatial(cells: DataFrame, block: str = "block") -> DataFrame:
    """Neighbour statistics of rows of cells in the last frame: H_s (equal neighbours) and rho (lag-1 autocorrelation)."""
    last = cells.join(cells.groupBy(block).agg(F.max("t").alias("t")), [block, "t"])
    w = W.partitionBy(block).orderBy("x")
    n = last.withColumns({"nx": F.lead("c").over(w), "mu": F.avg("c").over(W.partitionBy(block)), "va": F.var_pop("c").over(W.partitionBy(block))})
    g = n.groupBy(block).agg(F.avg((F.col("c") == F.col("nx")).cast("double")).alias("eq"), F.avg((F.col("c") - F.col("mu")) * (F.col("nx") - F.col("mu"))).alias("cov"), F.max("va").alias("va"), F.count_distinct("c").alias("m"), F.count("*").alias("n"), F.avg((F.abs(F.col("c") - F.col("nx")) > 1).cast("double")).alias("edges"))
    rho = F.when(F.col("va") < 1e-10, 1.0).otherwise(F.least(F.greatest((F.col("cov") / F.col("va") + 1) / 2, F.lit(0.0)), F.lit(1.0)))
    return g.select(block, F.coalesce("eq", F.lit(1.0)).alias("H_s"), rho.alias("rho"), (0.3 * F.col("m") / F.least("n", F.lit(256)) + 0.7 * F.coalesce("edges", F.lit(0.0))).alias("texture"))
