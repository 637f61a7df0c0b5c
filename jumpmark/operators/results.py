"""Analytics over benchmark runs: summaries, rankings, best per group, rate-distortion, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark.functions import probability


def with_ratio(runs: DataFrame) -> DataFrame:
    return runs.withColumn("ratio", F.when(F.col("output_size") > 0, F.col("input_size") / F.col("output_size")).otherwise(0.0))


def positive_mean(c: str) -> Column:
    """Mean over positive values; 0 without any."""
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def summary(runs: DataFrame) -> DataFrame:
    return with_ratio(runs).groupBy("codec").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio"), positive_mean("psnr").alias("psnr"), positive_mean("ssim").alias("ssim"), F.avg("bitrate").alias("bitrate"), (F.sum("input_size") / F.sum("output_size")).alias("overall_ratio"))


def compare(runs: DataFrame, metric: str) -> DataFrame:
    """Mean, spread, extremes and median of a metric by codec; the median is taken over distinct values with their counts."""
    whole = runs.groupBy("codec").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    middle = runs.groupBy("codec", metric).agg(F.count("*").alias("k")).groupBy("codec").agg(F.percentile(metric, F.lit(0.5), F.col("k")).alias("median"))
    return whole.join(middle, "codec")


def best_per(runs: DataFrame, group: str, metric: str, largest: bool, name: str = "codec") -> DataFrame:
    """The name with the best metric in each group; ties go to the first name."""
    score = F.col(metric) if not largest else -F.col(metric)
    return runs.groupBy(group).agg(F.min(F.struct(score.alias("s"), F.col(name).alias(name), F.col("quality_param"))).alias("b")).select(group, f"b.{name}", "b.quality_param", (F.col("b.s") * (-1 if largest else 1)).alias(metric))


def last_write(runs: DataFrame) -> DataFrame:
    """Upsert by (video, codec): the last quality level wins."""
    return runs.groupBy("video", "codec").agg(F.max_by(F.struct(*runs.columns), "quality_param").alias("r")).select("r.*")


def rankings(runs: DataFrame, metrics: list[str]) -> DataFrame:
    s = summary(runs)
    return s.select("codec", *(F.row_number().over(W.orderBy(F.col(m).desc(), "codec")).alias(f"rank_{m}") for m in metrics))


def rd_points(runs: DataFrame) -> DataFrame:
    return runs.groupBy("video", "codec").agg(F.array_sort(F.collect_list(F.struct("bitrate", "psnr"))).alias("p")).select("video", "codec", F.size("p").alias("n"), F.posexplode("p").alias("i", "pt")).select("video", "codec", "n", "i", "pt.bitrate", "pt.psnr")


def pairs(runs: DataFrame, metric: str) -> DataFrame:
    """Each unordered pair of codecs with its paired differences by video: n, mean, t statistic, Cohen's d."""
    per = runs.groupBy("video", "codec").agg(F.avg(metric).alias("v"))
    a, b = per.alias("a"), per.alias("b")
    j = a.join(b, (F.col("a.video") == F.col("b.video")) & (F.col("a.codec") < F.col("b.codec")))
    d = F.col("a.v") - F.col("b.v")
    g = j.groupBy(F.col("a.codec").alias("codec_a"), F.col("b.codec").alias("codec_b")).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.avg("a.v").alias("ma"), F.avg("b.v").alias("mb"), F.var_samp("a.v").alias("va"), F.var_samp("b.v").alias("vb"))
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    cohen = F.when((F.col("va") + F.col("vb")) > 0, (F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).otherwise(0.0)
    return g.select("codec_a", "codec_b", "n", "mean_diff", t.alias("t"), cohen.alias("d"))


def anova(runs: DataFrame, metric: str) -> DataFrame:
    """F statistic of codec groups, from one pass of group sums."""
    g = runs.groupBy("codec").agg(F.count("*").alias("n"), F.sum(metric).alias("s"), F.sum(F.col(metric) * F.col(metric)).alias("q"))
    a = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return a.select("k", "n", ((between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))).alias("f"))


def kruskal(runs: DataFrame, metric: str) -> DataFrame:
    """Tie-corrected H. Ranks come from the counts of distinct values, so only those are ordered in one place."""
    values = runs.groupBy(metric).agg(F.count("*").alias("t"))
    w = W.orderBy(metric).rowsBetween(W.unboundedPreceding, 0)
    ranks = values.withColumn("rk", F.sum("t").over(w) - (F.col("t") - 1) / 2)
    g = runs.join(ranks, metric).groupBy("codec").agg(F.count("*").alias("n"), F.sum("rk").alias("s"))
    n = g.agg(F.sum("n").alias("N"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    ties = values.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    h = 12.0 / (F.col("N") * (F.col("N") + 1)) * F.col("b") - 3 * (F.col("N") + 1)
    nn = F.col("N").cast("double")
    return n.crossJoin(ties).select("k", "N", (h / (1 - F.col("ties") / (nn * nn * nn - nn))).alias("h"))


def confidence(runs: DataFrame, metric: str, z: float = 1.96) -> DataFrame:
    g = runs.groupBy("codec").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count("*"))).alias("se"))
    return g.select("codec", "n", "mean", (F.col("mean") - z * F.col("se")).alias("lo"), (F.col("mean") + z * F.col("se")).alias("hi"))


def performance(runs: DataFrame) -> DataFrame:
    """Sums, means and extremes over all runs; the overall ratio is a ratio of sums."""
    r = with_ratio(runs)
    return r.agg(F.count("*").alias("n"), F.sum("input_size").alias("total_in"), F.sum("output_size").alias("total_out"), (F.sum("input_size") / F.sum("output_size")).alias("overall"), F.avg("ratio").alias("mean_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.stddev_pop("ratio").alias("std_ratio"))


def keep(runs: DataFrame, video: str | None = None, codec: str | None = None, quality: str | None = None) -> DataFrame:
    """Conjunctive equality; an argument that is empty is no condition."""
    for name, value in (("video", video), ("codec", codec), ("quality_param", quality)):
        if value:
            runs = runs.where(F.col(name) == value)
    return runs


def wilcoxon(runs: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """Signed ranks of paired differences by video: the smaller rank sum, and z by the normal approximation."""
    per = runs.groupBy("video").pivot("codec", [a, b]).agg(F.avg(metric))
    d = per.select(F.round(F.col(a) - F.col(b), 9).alias("d")).where("d <> 0")
    w = W.partitionBy("one").orderBy("m").rowsBetween(W.unboundedPreceding, 0)  # one row per distinct difference
    v = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up")).withColumn("one", F.lit(1))
    v = v.withColumn("rank", F.sum("k").over(w) - (F.col("k") - 1) / 2)
    g = v.agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("k") - F.col("up"))).alias("minus"))
    s = F.least("plus", "minus")
    n = F.col("n").cast("double")
    return g.select("n", s.alias("w"), ((s - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def bd_rate(runs: DataFrame, reference: str, quality: str = "psnr") -> DataFrame:
    """Bjontegaard rate difference (%) of each codec to a reference, pooled over videos; 0 where it is not defined.

    A cubic of log rate on quality needs only power sums, so each codec comes down to one row; the 4 x 4 systems are solved
    from those.
    """
    import numpy as np
    import pandas as pd

    q, y = F.col(quality), F.log10("bitrate")
    mid = runs.agg(F.avg(quality).alias("mid")).first()["mid"] or 0.0  # centred powers are better conditioned
    c = q - mid
    sums = runs.where("bitrate > 0").groupBy("codec").agg(F.count("*").alias("n"), F.min(quality).alias("lo"), F.max(quality).alias("hi"), *(F.sum(F.pow(c, F.lit(k))).alias(f"s{k}") for k in range(7)), *(F.sum(F.pow(c, F.lit(k)) * y).alias(f"y{k}") for k in range(4)))
    ref = sums.where(F.col("codec") == reference).select(*(F.col(n).alias(f"r_{n}") for n in sums.columns))

    def mean(row, prefix: str, lo: float, hi: float) -> float:
        a = np.array([[row[f"{prefix}s{i + j}"] for j in range(4)] for i in range(4)], dtype=float)
        p = np.linalg.solve(a, np.array([row[f"{prefix}y{i}"] for i in range(4)], dtype=float))
        return sum(p[k] * ((hi - mid) ** (k + 1) - (lo - mid) ** (k + 1)) / (k + 1) for k in range(4)) / (hi - lo)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                lo, hi, value = max(row["lo"], row["r_lo"]), min(row["hi"], row["r_hi"]), 0.0
                if min(row["n"], row["r_n"]) >= 4 and lo < hi:
                    try:
                        value = (10 ** (mean(row, "", lo, hi) - mean(row, "r_", lo, hi)) - 1) * 100
                    except np.linalg.LinAlgError:
                        value = 0.0
                out.append((row["codec"], value))
            yield pd.DataFrame(out, columns=["codec", "bd_rate"])

    return sums.where(F.col("codec") != reference).join(ref, F.lit(True)).mapInPandas(solve, "codec string, bd_rate double")


def best_per_metric(runs: DataFrame) -> DataFrame:
    """For each video the codec that is best by ratio, PSNR, SSIM (largest) and bitrate (smallest), in one aggregation."""
    score = {"ratio": -F.col("ratio"), "psnr": -F.col("psnr"), "ssim": -F.col("ssim"), "bitrate": F.col("bitrate")}
    g = with_ratio(runs).groupBy("video").agg(*(F.min(F.struct(s.alias("s"), "codec", "quality_param")).alias(k) for k, s in score.items()))
    return g.select("video", *(F.col(f"{k}.codec").alias(f"best_{k}") for k in score))


def pair_report(runs: DataFrame, metric: str) -> DataFrame:
    """pairs() with two-sided p and the size of the effect: negligible, small, medium, large from 0.2, 0.5, 0.8."""
    d = F.abs("d")
    size = F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")
    return pairs(runs, metric).withColumns({"p": probability.p_t(F.col("t"), (F.col("n") - 1).cast("double")), "effect": size})


def group_tests(runs: DataFrame, metric: str) -> DataFrame:
    """ANOVA and Kruskal-Wallis of the codec groups with their p values."""
    a = anova(runs, metric).select(F.lit("anova").alias("test"), F.col("f").alias("statistic"), probability.p_f(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")).alias("p"))
    k = kruskal(runs, metric).select(F.lit("kruskal"), F.col("h"), probability.p_chi2(F.col("h"), (F.col("k") - 1).cast("double")))
    return a.union(k)


def rate_verdict(rates: DataFrame) -> DataFrame:
    """bd_rate() in words, by bounds of -10, 0 and 10 percent."""
    r = F.col("bd_rate")
    return rates.withColumn("verdict", F.when(r < -10, "much better").when(r < 0, "better").when(r == 0, "equal").when(r < 10, "worse").otherwise("much worse"))


def derived(runs: DataFrame, seconds: Column, encode_seconds: Column, pixels: int) -> DataFrame:
    """runs with bitrate_kbps, fps and bits_per_pixel; each is 0 where what it divides by is not positive."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return runs.withColumns({"bitrate_kbps": per(F.col("output_size") * 8 / 1000, seconds), "fps": per(F.col("n_frames"), encode_seconds), "bits_per_pixel": per(F.col("output_size") * 8, pixels * F.col("n_frames"))})


def append(runs: DataFrame, path: str) -> DataFrame:
    """A store of runs with these added: appended as files, earlier ones stay as they are."""
    runs.write.mode("append").parquet(path)
    return runs.sparkSession.read.schema(runs.schema).parquet(path)


def lookup(store: DataFrame, video: str, codec: str) -> DataFrame:
    """The runs of one video and codec."""
    return keep(store, video=video, codec=codec)


def summary_table(store: DataFrame, metrics: list[str]) -> str:
    """Means by codec as a text table (a row a codec)."""
    rows = store.groupBy("codec").agg(*(F.round(F.avg(m), 3).alias(m) for m in metrics)).orderBy("codec").collect()
    lines = [["codec", *metrics], *([str(v) for v in r] for r in rows)]
    wide = [max(len(line[i]) for line in lines) for i in range(len(lines[0]))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, wide, strict=True)).rstrip() for line in lines)
