"""Choosing among representations and statistical frameworks: thresholds by table or closed form, expected lengths, small trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumpmark.functions.scalar import log2_comb

# For a resolution r, the least and the most jumps for which a presence vector beats the combinatorial form.
GAMMA = {
    30: (12, 19), 60: (24, 37), 120: (51, 70), 240: (105, 136), 256: (113, 144), 480: (217, 264), 512: (232, 281),
    900: (417, 484), 1024: (476, 549), 1800: (850, 951), 2048: (970, 1079), 3600: (1724, 1877), 4096: (1967, 2130),
}
# For r and 2, 4, 8, 16, 32, 64 colours, jumps above which the full state beats the presence vector.
DELTA = {
    120: (0, 60, 81, 90, 96, 100), 240: (0, 120, 161, 180, 192, 200), 256: (0, 128, 171, 192, 205, 214),
    512: (0, 256, 342, 384, 410, 427), 900: (0, 450, 601, 675, 720, 750), 1024: (0, 512, 683, 768, 820, 854),
}
# For r and 2, 4, 8, 16, 32, 64 colours, jumps up to which the combinatorial form beats the full state.
LAMBDA = {
    120: (26, 58, 83, 99, 108, 112), 240: (53, 118, 168, 200, 217, 227), 256: (57, 126, 180, 213, 232, 242),
    512: (115, 254, 361, 429, 467, 487), 900: (203, 448, 637, 756, 823, 858), 1024: (231, 510, 725, 860, 937, 977),
}
COLORS = (2, 4, 8, 16, 32, 64)


def gamma_bounds(r: Column) -> tuple[Column, Column]:
    """Both bounds: from the table, linear between its rows (half to even), its ends beyond them."""
    known = sorted(GAMMA)

    def side(k: int) -> Column:
        out = F.when(r <= known[0], GAMMA[known[0]][k])
        for a, b in zip(known, known[1:], strict=False):
            lo, hi = GAMMA[a][k], GAMMA[b][k]
            out = out.when(r <= b, F.bround(lo + (r - a) / F.lit(float(b - a)) * (hi - lo)).cast("int"))
        return out.otherwise(GAMMA[known[-1]][k])

    return side(0), side(1)


def _tabled(table: dict[int, tuple[int, ...]], r: Column, m: Column, beyond: Column) -> Column:
    rows = F.create_map(*(x for a, vs in table.items() for c, v in zip(COLORS, vs, strict=True) for x in (F.lit(a * 100 + c), F.lit(v))))
    known = r.isin(*table) & m.isin(*COLORS)
    return F.when(m <= 1, r).when(known, F.try_element_at(rows, (r * 100 + m).cast("int"))).otherwise(beyond).cast("int")


def delta_threshold(r: Column, m: Column) -> Column:
    """Jumps above which the full state wins over the presence vector; r where there is one colour."""
    return _tabled(DELTA, r, m, F.greatest(F.lit(0), F.ceil(r * (1 - 1 / F.log2(F.greatest(m, F.lit(2)))))))


def lambda_bound(params: DataFrame, r: str = "r", m: str = "m") -> DataFrame:
    """params (distinct r, m) with lambda_bound: the most jumps for which the combinatorial form costs at most the full state.

    Beyond the table the lengths of all counts of a pair are laid out as rows. They rise, then fall, and at n = r are still
    above the full state's, so the bound is one less than the first count that costs more.
    """
    tab = _tabled(LAMBDA, F.col(r), F.col(m), F.lit(None))
    known = params.select(r, m).distinct().withColumn("tab", tab)
    open_pairs = known.where("tab is null").select(r, m, F.explode(F.sequence(F.lit(0), F.col(r))).alias("n"))
    length = F.when(F.col("n") > 0, F.log2(F.col("n") + 1.0) + log2_comb(F.col(r), F.col("n")) + F.col("n") * F.log2(m)).otherwise(0.0)
    sized = open_pairs.withColumn("over", length > F.col(r) * F.log2(m) + 1e-9)
    found = sized.groupBy(r, m).agg((F.coalesce(F.min(F.when(F.col("over"), F.col("n"))), F.col(r) + 1) - 1).alias("own"))
    return known.join(found, [r, m], "left").select(r, m, F.coalesce("tab", "own").cast("int").alias("lambda_bound"))


def zone_exists(r: Column) -> Column:
    """Whether the presence vector can win at all: always from 30 bins on, else by the length at half of them."""
    half = F.floor(r / 2).cast("int")
    return (r >= 30) | (F.log2(half + 1.0) + log2_comb(r, half) > r)


#: order in which ties are broken
FRAMEWORKS = ("vector", "marked", "spatial", "markov")


def framework_lengths(n: Column, channels: Column, t: Column, marks: Column, places: Column, states: Column, transitions: Column, k: int = 6) -> dict[str, Column]:
    """Expected code lengths (bits) under uniform intensities plus the parameters' cost, k coefficients an intensity.

    n: jumps in all; each term is the number of coded items times the bits of one, and half a log n per parameter.
    """
    per = F.log2(F.greatest(n, F.lit(2))) / 2
    bits = lambda *x: F.log2(F.greatest(_product(x), F.lit(1.0)))
    pairs = states * (states - 1)
    return {
        "vector": n * bits(t, marks) + channels * k * per,
        "marked": n * bits(t, marks) + (k + marks - 1) * per,
        "spatial": n * bits(places, marks) + k * per,
        "markov": transitions * bits(t, marks) + pairs * k * per,
    }


def _product(columns: tuple[Column, ...]) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * c
    return out


def framework_tree(m: Column, density: Column) -> Column:
    """Few marks, or many jumps: a vector of processes; else one marked process."""
    return F.when((m <= 5) | (density > 0.67), "vector").otherwise("marked")


def family_tree(density: Column, energy: Column, peak: Column, r: Column) -> Column:
    """Basis family by density, spectral energy and peak ratio, resolution."""
    return F.when(density < 0.01, "constant").when((energy > 50) & (peak > 1.8), "trigonometric").when(r <= 32, "wavelet").otherwise("bspline")


def level_costs(values: DataFrame, levels: list[tuple[str, int]], block: str = "block_id") -> DataFrame:
    """Colour costs of values coded level by level: uniform, Huffman (entropy and dictionaries), sequential estimate.

    levels: (column, bits). One explode, two hash aggregations, whatever the number of levels.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.col(c).cast("int").alias("v")) for i, (c, _) in enumerate(levels)))).alias("e")
    counts = values.select(block, each).select(block, "e.*").groupBy(block, "level", "v").agg(F.count("*").alias("n"))
    per = counts.groupBy(block, "level").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"), (F.max("v") + 1).alias("m"))
    coded = F.col("n") * F.log2("n") - F.col("s") + F.col("m") * (F.floor(F.log2("m")) + 1)
    total = sum(b for _, b in levels)
    g = per.groupBy(block).agg(F.max("n").alias("n"), F.sum(coded).alias("huffman"))
    return g.select(block, (F.col("n") * total).cast("double").alias("uniform"), "huffman", (F.col("n") * total * 0.3).alias("sequential"))


def simulation_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values with config_id, by integer division of a range (the first axis varies slowest)."""
    total = 1
    for vs in axes.values():
        total *= len(vs)
    out, span = [], total
    for name, vs in axes.items():
        span //= len(vs)
        out.append(F.get(F.array(*(F.lit(v) for v in vs)), (F.expr(f"id div {span}") % len(vs)).cast("int")).alias(name))
    return spark.range(total).select(F.col("id").alias("config_id"), *out)
