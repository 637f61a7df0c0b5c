"""Exhaustive search over threshold configurations.

The objective of a configuration depends on a block only through the class its thresholds put it in, so blocks are first
counted by feature cell; the configurations (a fixed grid) are then combined with those cells, never with blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark.functions.scalar import log2_comb
from jumpmark.operators.costs import temporal_costs

#: threshold -> (smallest, largest, steps); the last one varies fastest
GRID = {"H_s": (0.5, 0.9, 5), "rho_high": (0.6, 0.95, 5), "rho_low": (0.05, 0.3, 5), "chi2": (0.01, 0.1, 4), "R1_max": (0.05, 0.2, 4), "R4b_R2": (0.7, 0.9, 4), "R4a_min": (0.4, 0.65, 4)}


def values(span: tuple[float, float, int]) -> list[float]:
    low, high, n = span
    return [round(low + i * (high - low) / (n - 1), 10) for i in range(n)]


def configs(spark: SparkSession, grid: dict[str, tuple[float, float, int]] = GRID) -> DataFrame:
    """All combinations with config_id in nested-loop order, by integer division of one range (no join)."""
    total = reduce(lambda a, g: a * g[2], grid.values(), 1)
    out, step = spark.range(total).withColumnRenamed("id", "config_id"), total
    for name, (low, high, n) in grid.items():
        step //= n
        steps = F.array(*(F.lit(v) for v in values((low, high, n))))
        out = out.withColumn(name, F.get(steps, (F.floor(F.col("config_id") / step) % n).cast("int")))
    return out


def predicted(features: DataFrame) -> DataFrame:
    """features with the classifier's choices (pa, pb, pc), the cheapest ones (oa, ob, oc), their costs (cost, optimum).

    features: N, r, m, H, n_trans, m_eff and, where known, counts (jumps by colour; else they are taken as evenly spread over
    the effective colours, or as one).
    """
    from jumpmark.operators import costs as C

    n, r = F.col("N"), F.col("r")
    if "counts" not in features.columns:
        each = F.when(F.col("m_eff") > 0, F.floor(n / F.col("m_eff"))).otherwise(n)
        rest = F.when(F.col("m_eff") > 0, n % F.col("m_eff")).otherwise(0)
        split = F.transform(F.sequence(F.lit(1), F.greatest(F.col("m_eff"), F.lit(1))), lambda i: each + F.when(i <= rest, 1).otherwise(0))
    else:
        split = F.transform("counts", lambda c: F.floor(c / n * n))
    mono = F.aggregate(split, F.lit(0.0), lambda a, k: a + F.when(k > 0, F.log2(k + 1.0) + log2_comb(r.cast("int"), k.cast("int"))).otherwise(0.0))
    color, when_all, kind = C.color_costs(), C.temporal_costs_exhaustive(), C.type_costs()
    three = {k: color[k] for k in ("Ba", "Bb", "Bc")}
    f = features.withColumns({"a": F.array(*(v.cast("double") for v in kind.values())), "b": F.array(*(v.cast("double") for v in color.values())), "c": F.array(*(v.cast("double") for v in when_all.values())), "mono": mono})
    gain = when_all["R4b"] + F.least(*three.values()) - F.col("mono")
    few = (F.col("m") <= 4) & (F.col("m_eff") >= F.col("m") - 1)
    f = f.withColumn("pa", F.when((n > 0) & (few | (gain > 0)), 1).otherwise(0))
    f = f.withColumn("pb", F.when(F.col("m_eff") == 1, 1).otherwise(C.best(three)["ord"]))
    f = f.withColumn("pc", F.when(n == 0, 0).when(n < 50, 1).otherwise(4))
    low = lambda x: F.array_position(x, F.array_min(x)).cast("int") - 1  # noqa: E731  the first smallest
    f = f.withColumns({"oa": low("a"), "ob": low("b"), "oc": low("c"), "cost": F.get("a", "pa") + F.get("b", "pb") + F.get("c", "pc"), "optimum": F.array_min("a") + F.array_min("b") + F.array_min("c")})
    return f.drop("a", "b", "c", "mono")


def objective(features: DataFrame, grid_configs: DataFrame, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """Each configuration's objective: alpha times the cost of what the classifier chooses, beta times what it costs too much.

    Beside it the accuracy of the choices. The classifier in use looks at no threshold, so that its sums are taken once over the
    blocks (one aggregation) and every configuration has the same ones.
    """
    p = predicted(features)
    over = F.greatest(F.col("cost") - F.col("optimum"), F.lit(0.0))
    hit = lambda *d: F.avg(sum(((F.col(f"p{k}") == F.col(f"o{k}")).cast("int") for k in d), F.lit(0)).eqNullSafe(len(d)).cast("int"))
    sums = p.agg(F.sum("cost").alias("encoding"), F.sum(over).alias("penalty"), F.count("*").alias("n_blocks"), hit("a", "b", "c").alias("exact"), *(hit(k).alias(f"acc_{k}") for k in "abc"), F.avg(over).alias("mean_penalty"), F.max(over).alias("max_penalty"))
    every = grid_configs.select("config_id").crossJoin(F.broadcast(sums))  # one row
    return every.select("config_id", (alpha * F.col("encoding") + beta * F.col("penalty")).alias("total"), *sums.columns)


def density_costs(features: DataFrame, grid_configs: DataFrame) -> DataFrame:
    """Cost of each configuration when the representation follows the jump density N / r and two thresholds.

    R1 up to R1_max, R4b up to R4b_R2, R2 above. Blocks are summed by density first, and only the distinct pairs of the
    thresholds concerned are combined with the densities; the sums go back to the configurations by an equi join.
    """
    t = temporal_costs()
    cells = features.groupBy("N", "r").agg(F.count("*").alias("blocks")).select("N", "r", "blocks", (F.col("N") / F.col("r")).alias("density"), *(t[k].alias(k) for k in ("R1", "R2", "R4b")))
    # the distinct pairs of two thresholds are few and fixed by the grid
    duos = F.array(*(F.struct(F.lit(a).alias("R1_max"), F.lit(b).alias("R4b_R2")) for a in values(GRID["R1_max"]) for b in values(GRID["R4b_R2"])))
    each = cells.select("*", F.explode(duos).alias("q")).select("blocks", "density", "R1", "R2", "R4b", "q.R1_max", "q.R4b_R2")
    cost = F.when(F.col("density") <= F.col("R1_max"), F.col("R1")).when(F.col("density") <= F.col("R4b_R2"), F.col("R4b")).otherwise(F.col("R2"))
    sums = each.groupBy("R1_max", "R4b_R2").agg(F.sum(cost * F.col("blocks")).alias("cost"))
    return grid_configs.join(sums, ["R1_max", "R4b_R2"]).select("config_id", *GRID, "cost")


def top(costs: DataFrame, k: int = 10) -> DataFrame:
    return costs.orderBy(F.round("cost", 6), "config_id").limit(k)


def running_minimum(costs: DataFrame, part: int = 256) -> DataFrame:
    """(config_id, best): the least cost up to each configuration. Parts of configurations are scanned on their own; only the parts' minima are scanned together."""
    parts = costs.withColumn("part", F.floor(F.col("config_id") / part))
    least = parts.groupBy("part").agg(F.min("cost").alias("least"))
    before = least.select("part", F.min("least").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = F.min("cost").over(W.partitionBy("part").orderBy("config_id").rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").select("config_id", F.least("own", "before").alias("best"))


def _draws(spark: SparkSession, n: int, seed: int, grid: dict[str, tuple[float, float, int]]) -> DataFrame:
    """(draw, a step of each threshold), each step by a digest of seed, draw and threshold."""
    from jumpmark.operators.generate import uniform

    step = lambda name, k: F.floor(uniform(seed, F.col("draw"), F.lit(name)) * k).cast("int").alias(name)
    return spark.range(n).withColumnRenamed("id", "draw").select("draw", *(step(name, span[2]) for name, span in grid.items()))


def sample(spark: SparkSession, n: int, seed: int = 42, grid: dict[str, tuple[float, float, int]] = GRID) -> DataFrame:
    """n configurations drawn with replacement."""
    out = _draws(spark, n, seed, grid)
    return out.select("draw", *(F.get(F.array(*(F.lit(v) for v in values(span))), F.col(name)).alias(name) for name, span in grid.items()))


def sample_ids(spark: SparkSession, n: int, seed: int = 42, grid: dict[str, tuple[float, float, int]] = GRID) -> DataFrame:
    """The config_id of each of sample()'s configurations."""
    at = F.lit(0)
    for name, (_, _, steps) in grid.items():
        at = at * steps + F.col(name)
    return _draws(spark, n, seed, grid).select(at.cast("long").alias("config_id"))


def resumable(path: str, spark: SparkSession, build) -> DataFrame:
    """What is written at path; build() is run and written only where no finished table is there."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_configs(configs: DataFrame, path: str) -> None:
    configs.write.mode("overwrite").json(path)


def load_configs(spark: SparkSession, path: str, grid: dict[str, tuple[float, float, int]] = GRID) -> DataFrame:
    return spark.read.schema("config_id long, " + ", ".join(f"{k} double" for k in grid)).json(path)


def neighbors(config_ids: DataFrame, grid: dict[str, tuple[float, float, int]] = GRID) -> DataFrame:
    """(config_id, neighbor): configurations one step up or down in one threshold."""
    total, moves, step = reduce(lambda a, g: a * g[2], grid.values(), 1), [], None
    step = total
    for name, (_, _, n) in grid.items():
        step //= n
        digit = F.floor(F.col("config_id") / step) % n
        moves += [F.when(digit > 0, F.col("config_id") - step), F.when(digit < n - 1, F.col("config_id") + step)]
    return config_ids.select("config_id", F.explode(F.array_compact(F.array(*moves))).alias("neighbor"))


def climb(costs: DataFrame, start: int, limit: int = 200) -> list[tuple[int, float]]:
    """First-improvement hill climb from a configuration; each step looks up its neighbours (at most 14 rows)."""
    spark = costs.sparkSession
    look = costs.select("config_id", "cost").cache()
    try:
        at = look.where(F.col("config_id") == start).first()
        path = [(at["config_id"], at["cost"])]
        for _ in range(limit):
            near = neighbors(spark.createDataFrame([(path[-1][0],)], "config_id long"))
            better = look.join(near.select(F.col("neighbor").alias("config_id")), "config_id").where(F.col("cost") < path[-1][1] - 1e-9).orderBy("config_id").first()
            if better is None:
                return path
            path.append((better["config_id"], better["cost"]))
        return path
    finally:
        look.unpersist()


def rule_loop(spark: SparkSession, rules: list[tuple[int, str]], measure, gain: float = 0.001, stalls: int = 5) -> DataFrame:
    """Try rules (priority, name) in order; keep one whose mean ratio grows by over `gain` without a regression.

    measure(name, kept) gives (video, bpp, ratio) under the rules kept so far and this one. Each step is one aggregation over all
    videos; what reaches the driver is its verdict, one row a rule. Stops after `stalls` rejections in a row.
    """
    from jumpmark.operators import joins

    best, log, idle, held = spark.createDataFrame([], "video string, bpp double, ratio double"), [], 0, []
    for place, (_, name) in enumerate(sorted(rules)):
        tried = measure(name, tuple(held))
        v = joins.judge(joins.deltas(tried, best)).first()
        kept = v["ratio"] is not None and v["ratio"] > gain and v["regressions"] == 0
        log.append((place, name, v["ratio"], v["regressions"], kept))
        if kept:
            best = tried
            held.append(name)
        idle = 0 if kept else idle + 1
        if idle >= stalls:
            break
    return spark.createDataFrame(log, "step int, rule string, gain double, regressions long, kept boolean")
