"""Synthetic cells over ranges: closed-form patterns, and seeded ones by hashing coordinates (any partitioning, same rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def grid(spark: SparkSession, r: int, nl: int, nc: int) -> DataFrame:
    i = F.col("id")
    return spark.range(r * nl * nc).select((F.floor(i / (nl * nc))).cast("int").alias("t"), (F.floor(i / nc) % nl).cast("int").alias("y"), (i % nc).cast("int").alias("x"))


def uniform(seed: int, *columns: Column) -> Column:
    """In [0, 1), from the MD5 digest of the seed and the columns, so that any engine draws the same."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), *(c.cast("string") for c in columns)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def gradient(cells: DataFrame, nl: int) -> DataFrame:
    return cells.withColumn("c", F.floor(F.col("y") * 255 / F.lit(max(1, nl - 1))).cast("int"))


def periodic(cells: DataFrame, period: int = 16) -> DataFrame:
    return cells.withColumn("c", F.floor(128 + 100 * F.sin(2 * F.pi() * (F.col("t") + F.col("x")) / period) + 0.5).cast("int"))


def moving_square(cells: DataFrame, size: int = 4) -> DataFrame:
    inside = (F.col("x") - F.col("t")).between(0, size - 1) & F.col("y").between(0, size - 1)
    return cells.withColumn("c", F.when(inside, 200).otherwise(50))


def bernoulli(cells: DataFrame, colors: int, p: float, seed: int = 42) -> DataFrame:
    """With probability p a pixel draws a new colour (it may be the old one); else it keeps its colour."""
    draw = F.floor(uniform(seed, F.lit("c"), F.col("t"), F.col("y"), F.col("x")) * colors).cast("int")
    change = (F.col("t") == 0) | (uniform(seed, F.lit("j"), F.col("t"), F.col("y"), F.col("x")) < p)
    w = W.partitionBy("y", "x").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("c", F.last(F.when(change, draw), ignorenulls=True).over(w))


#: Cumulative intensity of each family over t, with its parameters.
FAMILIES = {
    "homogeneous": lambda t, a=0.1, b=0.0: a * t,
    "linear": lambda t, a=0.05, b=0.001: a * t + b * t * t / 2,
    "exponential": lambda t, a=0.3, b=0.02: a / b * (1 - F.exp(-b * t)),
    "power": lambda t, a=0.5, b=0.5: a * F.pow(t, F.lit(b)),
}


def poisson(spark: SparkSession, family: str, pixels: int, frames: int, seed: int = 42) -> DataFrame:
    """Jumps of an inhomogeneous process: a frame jumps with probability 1 - exp(-increment of the cumulative intensity)."""
    big = FAMILIES[family]
    t = F.col("t").cast("double")
    p = 1 - F.exp(-(big(t + 1) - big(t)))
    g = spark.range(pixels * frames).select((F.floor(F.col("id") / frames)).cast("int").alias("pixel"), (F.col("id") % frames).cast("int").alias("t"))
    return g.withColumn("p", p).where(uniform(seed, F.lit(family), F.col("pixel"), F.col("t")) < F.col("p"))


def markov_marks(jumps: DataFrame, matrix: list[list[float]], seed: int = 42, key: str = "pixel") -> DataFrame:
    """Jumps (key, t) with a mark from a Markov chain along t that starts in state 0, by inverse cumulative rows.

    Each step's number depends on key and t only, so results do not depend on partitions. A step is a map of states to states,
    and the composition of all maps up to a jump is taken by one fold whose array only grows at its end's copy: the fold keeps
    the last state and writes marks to a string, so that it stays linear in a key's jumps.
    """
    sums = [[sum(row[: i + 1]) for i in range(len(row) - 1)] for row in matrix]
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in s)) for s in sums))
    u = jumps.select(key, "t", uniform(seed, F.lit("mark"), F.col(key), F.col("t")).alias("u"))
    steps = u.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "u"))).alias("s"))
    # where each state goes at each jump, then the path from state 0
    goes = F.transform("s", lambda s: F.transform(rows, lambda r: F.size(F.filter(r, lambda v: v <= s["u"]))))
    out = steps.select(key, "s", goes.alias("goes"))
    path = F.aggregate("goes", F.struct(F.lit(0).alias("at"), F.lit("").alias("marks")), lambda a, g: F.struct(F.get(g, a["at"]).alias("at"), F.concat_ws(",", F.nullif(a["marks"], F.lit("")), F.get(g, a["at"]).cast("string")).alias("marks")), lambda a: F.split(a["marks"], ","))
    both = out.select(key, F.explode(F.arrays_zip(F.col("s.t").alias("t"), path.alias("mark"))).alias("j"))
    return both.select(key, F.col("j.t").alias("t"), F.col("j.mark").cast("int").alias("mark"))


def color_video(cells: DataFrame, colors: int, p: float, seed: int = 42) -> DataFrame:
    """Cells of bernoulli() with r, g, b of a palette whose channels come from a hash of the seed and the colour."""
    channel = lambda name: F.floor(uniform(seed, F.lit(name), F.col("c")) * 256).cast("int").alias(name)
    return bernoulli(cells, colors, p, seed).select("t", "y", "x", "c", *(channel(n) for n in ("r", "g", "b")))


def _moving(cells: DataFrame, frames: int, lines: int, columns: int, size: int, swing: float) -> Column:
    """Whether a cell lies in a square that swings down and up once and goes right."""
    h, w = min(size, lines // 2), min(size, columns // 2)
    top = F.floor((lines - h) * (0.5 + swing * F.sin(2 * F.pi() * F.col("t") / frames)))
    left = F.floor((columns - w) * F.col("t") / frames)
    return (F.col("y") >= top) & (F.col("y") < top + h) & (F.col("x") >= left) & (F.col("x") < left + w)


def static_background(cells: DataFrame, frames: int, lines: int, columns: int, seed: int = 42) -> DataFrame:
    """A still background of 40 to 79 with a moving square of 200."""
    still = F.floor(40 + 40 * uniform(seed, F.lit("bg"), F.col("y"), F.col("x"))).cast("int")
    return cells.withColumn("c", F.when(_moving(cells, frames, lines, columns, 16, 0.4), 200).otherwise(still))


def color_static_background(cells: DataFrame, frames: int, lines: int, columns: int, seed: int = 42) -> DataFrame:
    """The same in colour: channels of 20 to 59, 80 to 119, 40 to 79; the square is (220, 50, 50)."""
    inside = _moving(cells, frames, lines, columns, 12, 0.3)
    still = lambda name, low: F.floor(low + 40 * uniform(seed, F.lit(name), F.col("y"), F.col("x"))).cast("int")
    return cells.select("t", "y", "x", *(F.when(inside, v).otherwise(still(n, low)).alias(n) for n, low, v in (("r", 20, 220), ("g", 80, 50), ("b", 40, 50))))


def animation(cells: DataFrame, frames: int, lines: int, columns: int, seed: int = 42) -> DataFrame:
    """Four by four flat zones, each of which takes the next of five colours in three frames of its own."""
    zone = [F.floor(F.col("y") / (lines // 4)), F.floor(F.col("x") / (columns // 4))]
    first = F.floor(uniform(seed, F.lit("z"), *zone) * 5)
    changes = sum(((F.floor((k + uniform(seed, F.lit("f"), F.lit(k), *zone)) * frames / 3) <= F.col("t")).cast("int") for k in range(3)), F.lit(0))
    return cells.withColumn("c", F.get(F.array(*(F.lit(v) for v in (30, 80, 130, 180, 220))), ((first + changes) % 5).cast("int")))


def noise(cells: DataFrame, seed: int = 42) -> DataFrame:
    """A base of 60 to 159 with up to 15 up or down in every frame."""
    base = F.floor(60 + 100 * uniform(seed, F.lit("base"), F.col("y"), F.col("x")))
    return cells.withColumn("c", (base - 15 + F.floor(31 * uniform(seed, F.lit("n"), F.col("t"), F.col("y"), F.col("x")))).cast("int"))


def poisson_jumps(spark: SparkSession, family: str, pixels: int, frames: int, seed: int = 42, **parameters: float) -> DataFrame:
    """Jumps (pixel, t) of an inhomogeneous process by inversion: unit steps of an exponential clock, mapped back to frames.

    A pixel's clock is its uniform numbers' running sum of -log; the frame of a clock value is the last one whose integral is
    below it (the integrals of whole frames are one small array, which suits any family, invertible in closed form or not).
    Several jumps in a frame count as one.
    """
    from jumpmark.functions.scalar import INTENSITIES

    whole = INTENSITIES[family][1]
    edges = [r["v"] for r in spark.range(frames + 1).select(whole(F.col("id").cast("double"), **parameters).alias("v")).collect()]  # frames + 1 numbers
    ends = F.array(*(F.lit(e - edges[0]) for e in edges[1:]))
    steps = F.transform(F.sequence(F.lit(0), F.lit(2 * frames)), lambda i: -F.log(F.greatest(uniform(seed, F.lit(family), F.col("id"), i), F.lit(1e-12))))
    clock = F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.when(a["s"] + x < edges[-1] - edges[0], F.array_append(a["all"], a["s"] + x)).otherwise(a["all"]).alias("all")), lambda a: a["all"])
    at = F.array_distinct(F.transform(clock, lambda s: F.size(F.filter(ends, lambda e: e <= s))))
    return spark.range(pixels).select(F.col("id").cast("int").alias("pixel"), F.explode(at).alias("t"))


def spatiotemporal_block(spark: SparkSession, family: str, side: int, frames: int, marks: int, seed: int = 42, markov: bool = True, **parameters: float) -> DataFrame:
    """(pixel, t, mark) of side x side independent pixels, with the parameters as columns: jumps by inversion, marks from a chain or uniform."""
    j = poisson_jumps(spark, family, side * side, frames, seed, **parameters)
    if markov:
        matrix = [[0.5 if i == k else 0.5 / (marks - 1) for k in range(marks)] for i in range(marks)]
        j = markov_marks(j, matrix, seed)
    else:
        j = j.withColumn("mark", F.floor(uniform(seed, F.lit("m"), F.col("pixel"), F.col("t")) * marks).cast("int"))
    return j.select("pixel", "t", "mark", F.lit(family).alias("family"), F.lit(frames).alias("frames"), F.lit(marks).alias("marks"))
