"""Intensity estimation: histograms, cumulative shares, moving averages, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def histogram(events: DataFrame, r: int, bins: int, block: str = "event_type") -> DataFrame:
    """Counts per bin (empty bins included) and the histogram intensity count / width."""
    width = r / bins
    k = F.least(F.floor(F.col("t") / width), F.lit(bins - 1)).cast("int")
    counted = events.groupBy(block, k.alias("bin")).agg(F.count("*").alias("n"))
    dense = events.select(block).distinct().select(block, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(counted, [block, "bin"], "left").select(block, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / width).alias("alpha"))


def cumulative(hist: DataFrame, block: str = "event_type") -> DataFrame:
    """Share of the total up to a bin; a linear ramp where there is nothing."""
    w = W.partitionBy(block)
    total, upto = F.sum("n").over(w), F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    ramp = (F.col("bin") + 1) / F.count("*").over(w)
    return hist.select(block, "bin", F.when(total > 0, upto / total).otherwise(ramp).alias("cdf"))


def moving(hist: DataFrame, size: int, block: str = "event_type") -> DataFrame:
    """Centred moving average of odd size; edges are reflected (a bin -1-i stands for bin i)."""
    half = size // 2
    n = F.max("bin").over(W.partitionBy(block)) + 1
    h = hist.withColumn("nb", n)
    at = F.explode(F.sequence(F.col("bin") - half, F.col("bin") + half)).alias("target")
    own = h.select(block, "n", "nb", "bin", F.array(F.col("bin"), -1 - F.col("bin"), 2 * F.col("nb") - 1 - F.col("bin")).alias("images"))
    placed = own.select(block, "n", "nb", F.explode("images").alias("bin")).where((F.col("bin") >= -half) & (F.col("bin") < F.col("nb") + half))
    spread = placed.select(block, "n", "nb", at).where("target >= 0 and target < nb")
    return spread.groupBy(block, F.col("target").alias("bin")).agg((F.sum("n") / size).alias("smooth"))


def hellinger(a: DataFrame, b: DataFrame, cls: str = "bin") -> DataFrame:
    """Half the squared difference of the square roots of two distributions (cls, p)."""
    j = a.select(cls, F.col("p").alias("pa")).join(b.select(cls, F.col("p").alias("pb")), cls, "full")
    d = F.sqrt(F.coalesce("pa", F.lit(0.0))) - F.sqrt(F.coalesce("pb", F.lit(0.0)))
    return j.agg((F.sum(d * d) / 2).alias("h2"))


def fit_errors(hist: DataFrame, smooth: DataFrame, r: int, bins: int, block: str = "event_type") -> DataFrame:
    """Constant estimate, root mean square distance of histogram and moving average, and the bound K ln n / (2 n) for K bins."""
    j = hist.join(smooth.select(block, "bin", "smooth"), [block, "bin"])
    n = F.sum("n")
    bound = F.when(n > 0, bins * F.log(n) / (2 * n)).otherwise(0.0)
    return j.groupBy(block).agg(n.alias("n"), (n / r).alias("constant"), F.sqrt(F.avg(F.pow((F.col("n") - F.col("smooth")) / (r / bins), 2))).alias("l2"), bound.alias("bound"))


def dimension_scores(events: DataFrame, r: int, sizes: tuple[int, ...], marks: int, precision: int = 8, block: str = "event_type") -> DataFrame:
    """(block, k, n, score): description length of the histogram fit with k bins, for every k, from one pass over the events.

    Minus the log-likelihood, half a log n and `precision` for each coefficient, and uniform marks.
    """
    k = F.explode(F.array(*(F.lit(s) for s in sizes))).alias("k")
    bins = events.select(block, "t", k).groupBy(block, "k", F.expr(f"(t * k) div {r}").alias("bin")).agg(F.count("*").alias("c"))
    n, kk = F.sum("c"), F.col("k").cast("double")
    loglik = F.sum(F.col("c") * F.log(F.col("c") * F.col("k") / r)) - n
    return bins.groupBy(block, "k").agg(n.alias("n"), loglik.alias("l")).select(block, "k", "n", (-F.col("l") + kk / 2 * F.log("n") + kk * precision + F.col("n") * F.log(F.lit(float(marks)))).alias("score"))


def best_dimension(scores: DataFrame, block: str = "event_type") -> DataFrame:
    """The size with the smallest score (to 9 digits); the smaller size wins ties."""
    return scores.groupBy(block).agg(F.min(F.struct(F.round("score", 9).alias("score"), "k")).alias("b")).select(block, "b.k", "b.score")


def quadrature(spark, true, estimate, span: float, exposed: float, points: int = 1000) -> DataFrame:
    """(h): Hellinger distance of two intensities, expressions of time, by points over [0, span] with a constant exposure."""
    t = F.col("id") * span / (points - 1)
    root = lambda f: F.sqrt(F.greatest(f(t), F.lit(1e-10)))
    return spark.range(points).agg(F.sqrt(0.5 * F.sum(F.pow(root(true) - root(estimate), 2) * exposed * (span / points))).alias("h"))


def bound_holds(h2: Column, error: float, dimension: int, n: int, tolerance: float = 1e-6) -> Column:
    """Whether the square of h2 is within the squared error of approximation and what the dimension costs (h2 is squared once more, as the bound is stated)."""
    import math

    return F.pow(h2, F.lit(2)) <= error**2 + dimension * math.log(n) / (2 * n) + tolerance


def newton_exponential(events: DataFrame, span: float, block: str = "event_type", rounds: int = 30) -> DataFrame:
    """(block, n, rate, growth): the intensity rate * exp(growth * t) on [0, span] that makes the times t likeliest.

    The rate follows from the growth, whose equation is solved by Newton's steps. They need the number and the sum of the times
    only, so a block is two sums and the steps are one expression. No times give nulls.
    """
    g = events.groupBy(block).agg(F.count("t").cast("double").alias("n"), F.sum(F.col("t") + 0.5).alias("s"))
    n, s = F.col("n"), F.col("s")

    def step(b, _):
        e = F.exp(b * span)
        slope = s + n / b - n * span * e / (e - 1)
        bend = -n / (b * b) + n * span * span * e / ((e - 1) * (e - 1))
        new = b - slope / bend
        return F.when(F.abs(new) < 1e-9, F.lit(1e-9)).otherwise(new)

    start = F.when(s / n > span / 2, 0.01).otherwise(-0.01)
    out = g.where("n > 0").withColumn("growth", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return out.select(block, F.col("n").cast("long").alias("n"), (n * F.col("growth") / (F.exp(F.col("growth") * span) - 1)).alias("rate"), "growth")
