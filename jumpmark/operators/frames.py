"""Operators on dense cells: quality of one frame against the next, prediction residuals, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def consecutive(cells: DataFrame, block: str = "block") -> DataFrame:
    """Cells with the same pixel's value in the frame before (p), without the first frame."""
    return cells.withColumn("p", F.lag("c").over(W.partitionBy(block, "x").orderBy("t"))).where("p is not null")


def quality(pairs: DataFrame, top: float = 15.0, by: tuple[str, ...] = ("block", "t")) -> DataFrame:
    """Mean absolute difference, PSNR (null for identical frames) and global SSIM of value c against p, in one pass."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    g = pairs.groupBy(*by).agg(F.avg(F.pow(F.col("c") - F.col("p"), 2)).alias("mse"), F.avg(F.abs(F.col("c") - F.col("p"))).alias("mad"), F.avg("c").alias("mc"), F.avg("p").alias("mp"), F.var_pop("c").alias("vc"), F.var_pop("p").alias("vp"), F.covar_pop("c", "p").alias("cov"))
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(top * top / F.col("mse")))
    ssim = ((2 * F.col("mc") * F.col("mp") + c1) * (2 * F.col("cov") + c2)) / ((F.col("mc") * F.col("mc") + F.col("mp") * F.col("mp") + c1) * (F.col("vc") + F.col("vp") + c2))
    return g.select(*by, "mad", psnr.alias("psnr"), ssim.alias("ssim"))


def residuals(cells: DataFrame, block: str = "block") -> DataFrame:
    """Residuals mod 256 of four predictions (none, left, time, mean of both); borders predict from 0."""
    left = F.coalesce(F.lag("c").over(W.partitionBy(block, "t").orderBy("x")), F.lit(0))
    before = F.coalesce(F.lag("c").over(W.partitionBy(block, "x").orderBy("t")), F.lit(0))
    p = cells.withColumns({"l": left, "u": before})
    modes = {"bypass": F.lit(0), "left": F.col("l"), "time": F.col("u"), "dc": F.shiftright(F.col("l") + F.col("u"), 1)}
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("mode"), (F.col("c") - v).bitwiseAND(F.lit(255)).alias("res")) for i, (k, v) in enumerate(modes.items())))
    return p.select(block, F.explode(each).alias("e")).select(block, "e.*")


def best_prediction(cells: DataFrame, block: str = "block") -> DataFrame:
    """The prediction whose residuals have least entropy; the first in order wins ties (to 9 digits)."""
    counts = residuals(cells, block).groupBy(block, "ord", "mode", "res").agg(F.count("*").alias("n"))
    h = counts.groupBy(block, "ord", "mode").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return h.groupBy(block).agg(F.min(F.struct(F.round("h", 9).alias("h"), "ord", "mode")).alias("b")).select(block, "b.mode", "b.h")


def palette(cells: DataFrame, color_bits: int = 8, block: str = "block") -> DataFrame:
    """Colours of a block, bits of an index, and whether indexing pays."""
    g = cells.groupBy(block).agg(F.count_distinct("c").alias("m"), F.count("*").alias("n"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2("m"))).cast("int")
    g = g.withColumn("index_bits", bits)
    return g.withColumns({"use": (F.col("index_bits") < color_bits) & (F.col("m") <= 64), "saving": F.col("n") * (color_bits - F.col("index_bits")) - F.col("m") * color_bits})


def nearest(colors: DataFrame, entries: list[tuple[int, ...]], channels: tuple[str, ...]) -> DataFrame:
    """Index of the nearest palette entry (squared distance, lowest index on ties), row by row over a fixed palette."""
    d = [F.struct(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(channels, e, strict=True)), F.lit(0)).cast("long").alias("d"), F.lit(i).alias("idx")) for i, e in enumerate(entries)]
    return colors.withColumn("near", F.array_min(F.array(*d))).select("*", F.col("near.idx").alias("idx"), F.col("near.d").alias("dist")).drop("near")


def split_bits(cells: DataFrame, sizes: tuple[int, ...] = (64, 32, 16, 8), block: str = "block") -> DataFrame:
    """Bits of every node (block, size, node) of a dyadic tree: entropy bits of its cells plus its colours."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.floor(F.col("x") / s).cast("int").alias("node")) for s in sizes))).alias("e")
    counts = cells.select(block, "c", each).select(block, "c", "e.*").groupBy(block, "size", "node", "c").agg(F.count("*").alias("n"))
    g = counts.groupBy(block, "size", "node").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("m"))
    return g.select(block, "size", "node", F.floor(F.round(F.col("N") * F.log2("N") - F.col("s") + 8 * F.col("m"), 6)).cast("long").alias("bits"))


def split_tree(bits: DataFrame, sizes: tuple[int, ...] = (64, 32, 16, 8), block: str = "block") -> DataFrame:
    """Bottom up: a node splits if 2 bits and its children's best cost less. One equi join per level."""
    best = bits.where(F.col("size") == sizes[-1]).select(block, "node", F.col("bits").alias("best"), F.lit(1).alias("leaves"))
    for s in sizes[-2::-1]:
        kids = best.groupBy(block, F.floor(F.col("node") / 2).cast("int").alias("node")).agg((F.sum("best") + 2).alias("split"), F.sum("leaves").alias("leaves"))
        own = bits.where(F.col("size") == s).select(block, "node", "bits")
        j = own.join(kids, [block, "node"])
        best = j.select(block, "node", F.least("bits", "split").alias("best"), F.when(F.col("split") < F.col("bits"), F.col("leaves")).otherwise(1).alias("leaves"))
    return best


def median_cut(colors: DataFrame, channels: tuple[str, ...], rounds: int = 4) -> DataFrame:
    """colors with box: 2^rounds boxes at most; each round cuts every box at the median of its widest channel.

    A round is one aggregation to a row per box (never more than the palette) and a broadcast join of those rows.
    """
    out = colors.withColumn("box", F.lit(0))
    for _ in range(rounds):
        spans = F.array_max(F.array(*(F.struct((F.max(c) - F.min(c)).cast("double").alias("span"), F.lit(-i).alias("o"), F.percentile(c, F.lit(0.5)).alias("cut")) for i, c in enumerate(channels))))
        cuts = out.groupBy("box").agg(spans.alias("s")).select("box", F.col("s.o").alias("o"), F.col("s.cut").alias("cut"))
        value = F.element_at(F.array(*(F.col(c).cast("double") for c in channels)), 1 - F.col("o"))
        out = out.join(F.broadcast(cuts), "box").withColumn("box", 2 * F.col("box") + (value > F.col("cut")).cast("int")).select(*colors.columns, "box")
    return out


def windowed_ssim(pairs: DataFrame, size: int = 7, top: float = 15.0, by: tuple[str, ...] = ("block", "t")) -> DataFrame:
    """Mean SSIM over all whole size x size windows of frames (y, x, c against p), with sample covariances.

    Window sums are moving sums along rows, then along columns, so a cell is never multiplied by the windows that hold it.
    Frames without a whole window give no row.
    """
    half, n = size // 2, size * size
    own = {"sc": F.col("c"), "sp": F.col("p"), "cc": F.col("c") * F.col("c"), "pp": F.col("p") * F.col("p"), "cp": F.col("c") * F.col("p"), "k": F.lit(1)}
    out = pairs.select(*by, "y", "x", *(v.cast("double").alias(a) for a, v in own.items()))
    for across, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy(*by, across).orderBy(along).rangeBetween(-half, half)
        out = out.select(*by, "y", "x", *(F.sum(a).over(w).alias(a) for a in own))
    out = out.where(F.col("k") == n)
    mc, mp = F.col("sc") / n, F.col("sp") / n
    spread = lambda q, a, b: (F.col(q) / n - a * b) * (n / (n - 1))
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    one = ((2 * mc * mp + c1) * (2 * spread("cp", mc, mp) + c2)) / ((mc * mc + mp * mp + c1) * (spread("cc", mc, mc) + spread("pp", mp, mp) + c2))
    return out.groupBy(*by).agg(F.avg(one).alias("ssim"), F.count("*").alias("windows"))


def subsample(cells: DataFrame, lines: int, columns: int) -> DataFrame:
    """(block, t, sy, sx, c): means of 2 x 2 cells, rounded by adding 2; the last line or column counts twice where their number is odd."""
    weight = lambda c, n: F.when((F.col(c) == n - 1) & F.lit(n % 2 == 1), 2).otherwise(1)
    s = cells.groupBy("block", "t", F.floor(F.col("y") / 2).alias("sy"), F.floor(F.col("x") / 2).alias("sx")).agg(F.sum(F.col("c") * weight("y", lines) * weight("x", columns)).alias("s"))
    return s.select("block", "t", "sy", "sx", F.floor((F.col("s") + 2) / 4).alias("c"))


def merge_planes(cells: DataFrame, small: DataFrame) -> DataFrame:
    """cells with chroma: the halved plane's value at each cell (nearest neighbour)."""
    at = cells.withColumns({"sy": F.floor(F.col("y") / 2), "sx": F.floor(F.col("x") / 2)})
    return at.join(small.withColumnRenamed("c", "chroma"), ["block", "t", "sy", "sx"]).drop("sy", "sx")


def through_lut(colors: DataFrame, palette: list[tuple[int, int, int]], shift: int = 3) -> DataFrame:
    """colors (r, g, b) with idx and pr, pg, pb of the palette entry nearest to the middle of their cell of 2^shift values a side.

    The table has a row for each of the cube's cells whatever the data, so it is built once and broadcast.
    """
    spark, n = colors.sparkSession, 256 >> shift
    cell = lambda k: F.floor(F.col("id") / n**k) % n
    cube = spark.range(n**3).select(*(cell(k).cast("int").alias(name) for k, name in ((2, "cr"), (1, "cg"), (0, "cb"))))
    half = (1 << shift) // 2
    far = lambda p: sum((F.pow(F.col(c) * (1 << shift) + half - v, 2) for c, v in zip(("cr", "cg", "cb"), p, strict=True)), F.lit(0.0))
    near = F.array_min(F.array(*(F.struct(far(p).alias("d"), F.lit(i).alias("idx"), F.lit(p[0]).alias("pr"), F.lit(p[1]).alias("pg"), F.lit(p[2]).alias("pb")) for i, p in enumerate(palette))))
    lut = cube.withColumn("near", near).select("cr", "cg", "cb", "near.idx", "near.pr", "near.pg", "near.pb")
    at = colors.withColumns({c: F.shiftright(F.col(v).cast("int"), shift) for c, v in (("cr", "r"), ("cg", "g"), ("cb", "b"))})
    return at.join(F.broadcast(lut), ["cr", "cg", "cb"])


def overlapping(cells: DataFrame, size: int, stride: int, lines: int, columns: int) -> DataFrame:
    """cells with block_y and block_x: a row for each block of size x size, every stride cells, that covers the cell."""
    last = lambda n: (n - size) // stride
    over = lambda c, n: F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) / stride), F.lit(last(n))).cast("int"))
    inside = (F.col("y") <= last(lines) * stride + size - 1) & (F.col("x") <= last(columns) * stride + size - 1)
    return cells.where(inside).withColumn("block_y", F.explode(over("y", lines))).withColumn("block_x", F.explode(over("x", columns)))


def seek(cells: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """The frames from first to last, every step-th by number; the range reaches the scan."""
    return cells.where(F.col("t").between(first, last) & (F.col("t") % step == 0))


def tiles(cells: DataFrame, size: int, lines: int, columns: int, levels: int) -> DataFrame:
    """Whole tiles of size x size cells (block_y, block_x); values of a byte become one of levels."""
    at = cells.withColumns({"block_y": F.floor(F.col("y") / size), "block_x": F.floor(F.col("x") / size), "c": F.floor(F.col("c") * (levels - 1) / 255)})
    return at.where((F.col("block_y") < lines // size) & (F.col("block_x") < columns // size))


def pyramid_levels(cells: DataFrame, side: int) -> DataFrame:
    """(block, t, level, tiles, residual): means of tiles from one a frame to one a cell, less the mean of the tile above."""
    s, level, above, out = side, 0, None, None
    while s >= 1:
        at = cells.groupBy("block", "t", F.floor(F.col("y") / s).alias("ty"), F.floor(F.col("x") / s).alias("tx")).agg(F.avg("c").alias("mean"))
        if above is None:
            d = at.withColumn("d", F.col("mean"))
        else:
            up = above.select("block", "t", F.col("ty").alias("uy"), F.col("tx").alias("ux"), F.col("mean").alias("up"))
            d = at.withColumns({"uy": F.floor(F.col("ty") / 2), "ux": F.floor(F.col("tx") / 2)}).join(up, ["block", "t", "uy", "ux"]).withColumn("d", F.col("mean") - F.col("up"))
        g = d.groupBy("block", "t").agg(F.count("*").alias("tiles"), F.sum(F.abs("d")).alias("residual")).withColumn("level", F.lit(level))
        out = g if out is None else out.unionByName(g)
        above, s, level = at, s // 2, level + 1
    return out.select("block", "t", "level", "tiles", "residual")
