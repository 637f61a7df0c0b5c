"""Blocks of cells (block, t, y, x, c): jumps, features, spatial statistics, classification and quadtree costs.

A block's frames and pixels are bounded by how the table is cut into blocks, so every group below is small; blocks are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark.functions.scalar import dictionary_bits, log2_comb, log2_safe

PIXEL = ("block", "y", "x")


def stepped(cells: DataFrame) -> DataFrame:
    """cells with p: the pixel's colour a frame earlier (null in its first)."""
    return cells.withColumn("p", F.lag("c").over(W.partitionBy(*PIXEL).orderBy("t")))


def jumps(cells: DataFrame) -> DataFrame:
    """(block, t, y, x, mark) of cells that differ from the frame before; marks are the raw colours."""
    return stepped(cells).where("p <> c").select("block", "t", "y", "x", F.col("c").alias("mark"))


def xor_masks(cells: DataFrame) -> DataFrame:
    """(block, t, positions, n_changed, mask): a frame's changed places in raster order and as a bit string of one word a row."""
    s = stepped(cells).where("p is not null")
    rows = s.groupBy("block", "t", "y").agg(F.sum(F.when(F.col("p") != F.col("c"), F.pow(F.lit(2.0), "x")).otherwise(0)).cast("long").alias("bits"))
    return rows.groupBy("block", "t").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_changed"), F.array_sort(F.collect_list(F.struct("y", "bits"))).alias("rows"))


def mask_algebra(masks: DataFrame) -> DataFrame:
    """Bit-set algebra of neighbouring frames' masks: sizes of their intersection, union and symmetric difference."""
    before = F.lag("rows").over(W.partitionBy("block").orderBy("t"))
    both = masks.withColumn("before", before).where("before is not null")
    size = lambda op: F.aggregate(F.zip_with("rows", "before", op), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return both.select(
        "block", "t", size(lambda a, b: a["bits"].bitwiseAND(b["bits"])).alias("n_and"), size(lambda a, b: a["bits"].bitwiseOR(b["bits"])).alias("n_or"),
        size(lambda a, b: a["bits"].bitwiseXOR(b["bits"])).alias("n_xor"),
    )


def ten_features(cells: DataFrame) -> DataFrame:
    """f1 to f10 of a block: jumps a pixel (mean, spread), colours, spread of the mean frame, spread, share of the commonest
    jump pattern, distinct transitions, change rate, share of the commonest colour, variance (all of the population)."""
    s = stepped(cells).withColumn("ch", (F.col("p") != F.col("c")).cast("int"))
    per = s.groupBy(*PIXEL).agg((1 + F.sum(F.coalesce("ch", F.lit(0)))).alias("n"), F.avg("c").alias("mean"), F.array_sort(F.collect_list(F.when(F.col("ch") == 1, F.col("t")))).alias("pattern"))
    pixels = per.groupBy("block").agg(F.avg("n").alias("f1"), F.stddev_pop("n").alias("f2"), F.stddev_pop("mean").alias("f4"))
    patterns = per.groupBy("block", "pattern").agg(F.count("*").alias("k")).groupBy("block").agg((F.max("k") / F.sum("k")).alias("f6"))
    colors = cells.groupBy("block", "c").agg(F.count("*").alias("k")).groupBy("block").agg(F.count("*").alias("f3"), (F.max("k") / F.sum("k")).alias("f9"))
    whole = s.groupBy("block").agg(F.stddev_pop("c").alias("f5"), F.avg("ch").alias("f8"), F.var_pop("c").alias("f10"))
    pairs = s.where("ch = 1").groupBy("block", "p", "c").agg(F.lit(1).alias("one")).groupBy("block").agg(F.count("*").alias("f7"))
    out = pixels.join(patterns, "block").join(colors, "block").join(whole, "block").join(pairs, "block", "left")
    return out.select("block", "f1", "f2", F.col("f3").cast("double").alias("f3"), "f4", "f5", "f6", F.coalesce("f7", F.lit(0)).cast("double").alias("f7"), F.coalesce("f8", F.lit(0.0)).alias("f8"), "f9", "f10")


def last_frames(cells: DataFrame) -> DataFrame:
    """The cells of each block's last frame: an aggregate and a join, no window over the block."""
    return cells.join(cells.groupBy("block").agg(F.max("t").alias("t")), ["block", "t"])


def spatial(cells: DataFrame) -> DataFrame:
    """H_s (share of equal neighbours, both directions) and rho (lag-1 autocorrelation, both directions, in [0, 1]) of last frames."""
    last = last_frames(cells)
    n = last.withColumns({"right": F.lead("c").over(W.partitionBy("block", "y").orderBy("x")), "below": F.lead("c").over(W.partitionBy("block", "x").orderBy("y"))})
    n = n.join(last.groupBy("block").agg(F.avg("c").alias("mu"), F.var_pop("c").alias("va"), F.count_distinct("y").alias("h"), F.count_distinct("x").alias("w")), "block")
    cov = lambda c: F.avg((F.col("c") - F.col("mu")) * (F.col(c) - F.col("mu")))
    same = lambda c: F.count_if(F.col("c") == F.col(c))
    g = n.groupBy("block", "va", "h", "w").agg((same("right") + same("below")).alias("same"), (F.count("right") + F.count("below")).alias("pairs"), cov("right").alias("ch"), cov("below").alias("cv"))
    rho = F.when((F.col("h") < 2) | (F.col("w") < 2), 0.5).when(F.col("va") < 1e-10, 1.0).otherwise(F.least(F.greatest(((F.col("ch") + F.col("cv")) / (2 * F.col("va")) + 1) / 2, F.lit(0.0)), F.lit(1.0)))
    return g.select("block", F.when(F.col("pairs") > 0, F.col("same") / F.col("pairs")).otherwise(1.0).alias("H_s"), rho.alias("rho"))


def features(cells: DataFrame, keys: tuple[str, ...] = ("block",)) -> DataFrame:
    """N, r (cells behind the first frame), m (colours of the block), m_max (largest colour and one), H, m_eff, n_trans by keys.

    n_trans counts neighbouring jumps, in the order of time and raster, with different marks.
    """
    s = cells.withColumn("p", F.lag("c").over(W.partitionBy(*dict.fromkeys((*keys, *PIXEL))).orderBy("t")))
    whole = s.groupBy(*keys).agg(F.count("p").alias("r"), F.count_distinct("c").alias("m"), (F.max("c") + 1).alias("m_max"))
    j = s.where("p <> c").withColumn("before", F.lag("c").over(W.partitionBy(*keys).orderBy("t", "y", "x")))
    trans = j.groupBy(*keys).agg(F.count_if(F.col("before") != F.col("c")).alias("n_trans"))
    marks = j.groupBy(*keys, "c").agg(F.count("*").alias("n"))
    n = F.sum("n")
    ent = marks.groupBy(*keys).agg(n.alias("N"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("H"), F.collect_list("n").alias("counts"))
    out = whole.join(ent, list(keys), "left").join(trans, list(keys), "left").na.fill(0, ["N", "H", "n_trans"])
    counts = F.coalesce("counts", F.array().cast("array<bigint>"))
    return out.withColumn("counts", counts).withColumn("m_eff", F.size(F.filter("counts", lambda x: x >= F.greatest(F.lit(2.0), 0.01 * F.col("N")))))


def color_best() -> Column:
    """The cheapest of the sequential, uniform and Huffman colour costs."""
    lm = log2_safe(F.col("m"))
    return F.least(lm * (1 + F.col("n_trans")), F.col("N") * lm, F.col("N") * F.col("H") + dictionary_bits(F.col("m")))


def mono_gain() -> Column:
    """Bits that a process for each colour saves against marks; a colour's jumps are its share times N, cut to whole ones."""
    n, r = F.col("N"), F.col("r")
    held = F.transform("counts", lambda c: F.floor(c / n * n).cast("int"))
    mono = F.aggregate(held, F.lit(0.0), lambda a, k: a + F.when(k > 0, F.log2(k + 1.0) + log2_comb(r, k)).otherwise(0.0))
    return F.when(n == 0, 0.0).otherwise(F.log2(n + 1.0) + log2_comb(r, n) + color_best() - mono)


def process_kind(gain: Column) -> Column:
    """The rule in use: empty blocks are marked; few colours, nearly all of them active, are a process each; else by the gain."""
    few = (F.col("m") <= 4) & (F.col("m_eff") >= F.col("m") - 1)
    return F.when(F.col("N") == 0, "MARKED").when(few | (gain > 0), "MONO").otherwise("MARKED")


def five_kinds(gain: Column, markov: Column, h_s: float = 0.7, high: float = 0.8, low: float = 0.15) -> Column:
    """The rule by thresholds: joint, marginal, Markov, a process each, marked."""
    return F.when((F.col("H_s") > h_s) & (F.col("rho") > high), "JOINT").when(F.col("rho") < low, "MARGINAL").when(markov, "MARKOV").when(gain > 0, "MONO").otherwise("MARKED")


def even_chi2_tail(x: Column, df: int) -> Column:
    """The upper tail of the chi-square distribution for an even number of degrees of freedom, as a finite sum."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(df // 2 - 1)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * x / 2 / k).alias("t"), (a["s"] + a["t"] * x / 2 / k).alias("s")), lambda a: a["s"])
    return F.exp(-x / 2) * terms


def markov_test(transitions: DataFrame, m: int, key: str = "block_id", level: float = 0.05) -> DataFrame:
    """(key, chi2, df, p_value, markov) of transition counts (key, h, j, n) against independence, one added to every cell.

    m states make an m x m table (Yates' correction for m = 2). Blocks without transitions are not Markov, with probability 1.
    """
    from jumpmark.functions.probability import p_chi2

    df = (m - 1) ** 2
    held = transitions.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("h") * m + F.col("j")).alias("cell"), F.col("n").cast("double").alias("n")))).alias("held"))
    cells = held.select(key, F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda i: 1.0 + F.coalesce(F.try_element_at("held", i.cast("long")), F.lit(0.0))).alias("o"))
    side = lambda f: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.aggregate(F.filter("o", lambda x, k: f(k) == i), F.lit(0.0), lambda a, x: a + x))
    s = cells.select(key, "o", side(lambda k: F.floor(k / m)).alias("rows"), side(lambda k: k % m).alias("cols"))
    total = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x)
    expected = F.transform("o", lambda x, k: F.get("rows", F.floor(k / m).cast("int")) * F.get("cols", (k % m).cast("int")) / total)
    off = 0.5 if m == 2 else 0.0
    part = lambda o, e: F.pow(F.greatest(F.abs(o - e) - F.least(F.lit(off), F.abs(o - e)), F.lit(0.0)), F.lit(2)) / e
    out = s.withColumn("chi2", F.aggregate(F.zip_with("o", expected, part), F.lit(0.0), lambda a, x: a + x))
    p = even_chi2_tail(F.col("chi2"), df) if df % 2 == 0 else p_chi2(F.col("chi2"), F.lit(float(df)))
    out = out.select(key, "chi2", F.lit(df).alias("df"), p.alias("p_value"))
    return out.withColumn("markov", F.col("p_value") < level)


def quadtree(cells: DataFrame, size: int = 8, least: int = 2, cost: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None) -> DataFrame:
    """(block, bits, leaves) of the cheapest quadtree over a block's size x size cells: split iff 2 bits and the children cost less.

    cost(cells, keys) gives (keys, bits) of the squares named by keys: any function that builds columns will do. Every level's
    squares are costed from the cells in one aggregation, then joined from the smallest up; bits are whole at every level.
    """
    cost = cost or square_cost

    def level(s: int) -> DataFrame:
        at = cells.withColumns({"by": F.floor(F.col("y") / s).cast("int"), "bx": F.floor(F.col("x") / s).cast("int")})
        return cost(at, ("block", "by", "bx")).select("block", "by", "bx", F.col("bits").alias("own"))

    best = level(least).select("block", "by", "bx", F.floor("own").alias("bits"), F.lit(1).alias("leaves"))
    s = least * 2
    while s <= size:
        up = best.groupBy("block", F.floor(F.col("by") / 2).cast("int").alias("by"), F.floor(F.col("bx") / 2).cast("int").alias("bx")).agg((F.sum("bits") + 2).alias("split"), F.sum("leaves").alias("parts"))
        both = level(s).join(up, ["block", "by", "bx"])
        cheaper = F.col("split") < F.col("own")
        best = both.select("block", "by", "bx", F.floor(F.when(cheaper, F.col("split")).otherwise(F.col("own"))).alias("bits"), F.when(cheaper, F.col("parts")).otherwise(1).alias("leaves"))
        s *= 2
    return best.select("block", "bits", "leaves")


def square_cost(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bits of a square of cells: its jump times as a combination, its marks by the cheapest colour mode; nothing for no jump."""
    f = features(cells, keys)
    return f.select(*keys, F.when(F.col("N") == 0, 0.0).otherwise(F.log2(F.col("N") + 1.0) + log2_comb(F.col("r"), F.col("N")) + color_best()).alias("bits"))


def structure(cells: DataFrame) -> DataFrame:
    """A block's palette size, visited states of its pixels (as bit masks), mean jumps a pixel (the first frame counts) and |2 mean / r - 1|."""
    per = stepped(cells).groupBy(*PIXEL).agg(F.count_if(F.col("p").isNull() | (F.col("p") != F.col("c"))).alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").cast("int"))).alias("visited"), F.count("*").alias("r"))
    g = per.groupBy("block").agg(F.avg("n").alias("mean_n"), F.max("r").alias("r"), F.bit_or("visited").alias("palette_mask"), F.count_if(F.bit_count("visited") == 1).alias("still_pixels"))
    return g.select("block", F.bit_count("palette_mask").alias("m"), "palette_mask", "still_pixels", "mean_n", F.abs(2 * F.col("mean_n") / F.col("r") - 1).alias("symmetry"))
