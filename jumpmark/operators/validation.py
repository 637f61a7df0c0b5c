"""Prediction against optimum: accuracies, penalties, confusion matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DIMS = ("a", "b", "c")


def _match(d: str):
    return F.col(f"act_{d}") == F.col(f"pred_{d}")


def accuracy(p: DataFrame) -> DataFrame:
    """Shares of matches, and the penalties' mean, spread and interpolated percentiles.

    Penalties are counted by value first, so what meets in one place are distinct values, not blocks.
    """
    penalty = F.greatest(F.col("predicted_cost") - F.col("optimal_cost"), F.lit(0.0))
    hits = {"exact": _match("a") & _match("b") & _match("c"), **{f"acc_{d}": _match(d) for d in DIMS}}
    per = p.groupBy(penalty.alias("pe")).agg(F.count("*").alias("k"), *(F.count_if(c).alias(n) for n, c in hits.items()))
    total = F.sum("k")
    mean = F.sum(F.col("pe") * F.col("k")) / total
    q = F.percentile("pe", F.array(*(F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99))), F.col("k"))
    g = per.agg(total.alias("n"), *((F.sum(n) / total).alias(n) for n in hits), mean.alias("mean_penalty"), F.max("pe").alias("max_penalty"), F.sqrt(F.greatest(F.sum(F.col("pe") * F.col("pe") * F.col("k")) / total - mean * mean, F.lit(0.0))).alias("std_penalty"), q.alias("q"))
    return g.select("n", *hits, "mean_penalty", "max_penalty", "std_penalty", *(F.col("q")[i].alias(f"p{x}") for i, x in enumerate((50, 75, 90, 95, 99))))


def confusion(p: DataFrame) -> DataFrame:
    """Counts per dimension, actual and predicted class, from one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"act_{d}").alias("act"), F.col(f"pred_{d}").alias("pred")) for d in DIMS)))
    return p.select(cells.alias("x")).select("x.*").groupBy("dim", "act", "pred").agg(F.count("*").alias("n"))


def precision_recall(cm: DataFrame) -> DataFrame:
    classes = cm.select("dim", F.col("act").alias("cls")).union(cm.select("dim", "pred")).distinct()
    hit = cm.where("act = pred").select("dim", F.col("act").alias("cls"), F.col("n").alias("tp"))
    rows = cm.groupBy("dim", F.col("act").alias("cls")).agg(F.sum("n").alias("na"))
    cols = cm.groupBy("dim", F.col("pred").alias("cls")).agg(F.sum("n").alias("np"))
    j = classes.join(hit, ["dim", "cls"], "left").join(rows, ["dim", "cls"], "left").join(cols, ["dim", "cls"], "left").na.fill(0)
    p, r = (F.when(F.col(x) > 0, F.col("tp") / F.col(x)).otherwise(0.0) for x in ("np", "na"))
    j = j.select("dim", "cls", p.alias("precision"), r.alias("recall"))
    return j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def worst(cm: DataFrame, k: int = 5) -> DataFrame:
    w = W.partitionBy("dim").orderBy(F.col("n").desc(), "act", "pred")
    return cm.where("act <> pred").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def error_combinations(p: DataFrame) -> DataFrame:
    e = p.select(*((~_match(d)).alias(f"err_{d}") for d in DIMS))
    return e.groupBy("err_a", "err_b", "err_c").agg(F.count("*").alias("n"))
