"""Integer description lengths of blocks of pixels: per-pixel representations and whole-block processes."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jumpmark.functions.scalar import gamma_bits

LONGEST = 32


def binomial_bits(r: Column, n: Column) -> Column:
    """Bits of an index below comb(r, n), from a table computed for r up to LONGEST."""
    rows = F.array(*(F.array(*(F.lit((comb(a, b) - 1).bit_length()) for b in range(LONGEST + 1))) for a in range(LONGEST + 1)))
    return F.get(F.get(rows, r.cast("int")), n.cast("int"))


def pixels(cells: DataFrame, gop: int = LONGEST, block: str = "block") -> DataFrame:
    """Per pixel of a group of pictures: frames r, jumps n (the first frame counts), first colour, distinct transitions."""
    frames = cells.select(block, "t").distinct().withColumn("f", F.row_number().over(W.partitionBy(block).orderBy("t")) - 1)
    c = cells.join(frames, [block, "t"]).withColumn("gop", F.floor(F.col("f") / gop).cast("int"))
    w = W.partitionBy(block, "gop", "x").orderBy("f")
    c = c.withColumn("p", F.lag("c").over(w)).withColumn("b", F.coalesce(F.col("c") != F.col("p"), F.lit(True)))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", F.col("b").cast("int").alias("b")))), lambda s: s["b"].cast("string")), "")
    return c.groupBy(block, "gop", "x").agg(F.count("*").alias("r"), F.count_if("b").alias("n"), F.min_by("c", "f").alias("first"), pattern.alias("pattern"), F.collect_set(F.when(F.col("p").isNotNull() & F.col("b"), F.struct("p", "c"))).alias("tr"))


def representation_lengths(px: DataFrame, color_bits: int = 8, block: str = "block") -> DataFrame:
    """Four lengths per pixel with d bits for a time: raw, dates, bit vector, combinatorial index."""
    d = F.length(F.bin("r"))
    n, c = F.col("n"), F.lit(color_bits)
    return px.select(block, "gop", "x", (F.col("r") * c).alias("L1"), (d + n * (d + c)).alias("L2"), (F.col("r") + n * c).alias("L3"), (d + binomial_bits(F.col("r"), n) + n * c).alias("L4"))


def block_lengths(px: DataFrame, color_bits: int = 8, block: str = "block") -> DataFrame:
    """Lengths of a block as one colour, as independent pixels, by its dominant pattern, and by transitions; -1: impossible.

    Colours have a fixed width here (no Huffman table).
    """
    cb = color_bits
    d = F.length(F.bin("r"))
    lengths = representation_lengths(px, cb, block).groupBy(block, "gop").agg(*(F.sum(f"L{i}").alias(f"L{i}") for i in range(1, 5)))
    whole = px.groupBy(block, "gop").agg(F.max("r").alias("r"), F.count("*").alias("px"), F.sum("n").alias("jumps"), (F.max("n") == 1).alias("still"), F.count_distinct("first").alias("firsts"), F.size(F.array_distinct(F.flatten(F.collect_list("tr")))).alias("nb"))
    by = px.withColumn("r4", d + binomial_bits(F.col("r"), F.col("n")) + F.col("n") * cb).groupBy(block, "gop", "pattern").agg(F.count("*").alias("k"), F.max("n").alias("nd"), F.sum("r4").alias("r4"))
    top = by.groupBy(block, "gop").agg(F.max(F.struct("k", "pattern", "nd", "r4")).alias("t"), F.sum("r4").alias("all4"), F.sum("k").alias("px2"))
    j = whole.join(lengths, [block, "gop"]).join(top, [block, "gop"])
    mono = F.when(F.col("still") & (F.col("firsts") == 1), F.lit(7 + cb)).otherwise(-1)
    pp = 8 + F.least("L1", "L2", "L3", "L4")
    spatial = F.when(10 * F.col("t.k") >= 4 * F.col("px"), 8 + F.col("r") + gamma_bits(F.col("t.nd")) + F.col("t.k") * (1 + F.col("t.nd") * cb) + (F.col("px") - F.col("t.k")) + F.col("all4") - F.col("t.r4")).otherwise(-1)
    tbits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest("nb", F.lit(2)))))
    markov = F.when(F.col("nb") > 0, 7 + gamma_bits(F.col("nb")) + F.col("nb") * 2 * cb + 1 + F.col("px") * cb + F.col("px") * (F.col("r") - 1) + (F.col("jumps") - F.col("px")) * tbits).otherwise(-1)
    j = j.select(block, "gop", mono.cast("long").alias("mono"), pp.cast("long").alias("pp"), spatial.cast("long").alias("spatial"), markov.cast("long").alias("markov"))
    names = ("mono", "pp", "spatial", "markov")
    best = F.array_min(F.filter(F.array(*(F.struct(F.col(n).alias("bits"), F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(names))), lambda s: s["bits"] >= 0))
    return j.withColumn("process", best["name"])


def index_gain(px: DataFrame, colors: DataFrame, color_bits: int = 8, block: str = "block") -> DataFrame:
    """Bits of a block with colours as palette indices against colours in full, and the gain in percent.

    px: as pixels() gives; colors: (block, gop, m distinct colours).
    """
    n = F.col("n")
    per = px.groupBy(block, "gop").agg(F.sum(gamma_bits(n) + binomial_bits(F.col("r"), n)).alias("times"), F.sum("n").alias("jumps"), F.avg("n").alias("mean_jumps"))
    j = per.join(colors, [block, "gop"])
    width = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest("m", F.lit(2)))))
    j = j.withColumns({"indexed": gamma_bits(F.col("m")) + F.col("m") * color_bits + F.col("times") + F.col("jumps") * width, "plain": F.col("times") + F.col("jumps") * color_bits})
    return j.select(block, "gop", "m", "mean_jumps", F.col("indexed").cast("long").alias("indexed"), F.col("plain").cast("long").alias("plain"), F.when(F.col("plain") > 0, (1 - F.col("indexed") / F.col("plain")) * 100).otherwise(0.0).alias("gain"))


def pixel_colors(cells: DataFrame, gop: int = LONGEST, block: str = "block") -> DataFrame:
    """(block, gop, m): distinct colours of a group of pictures."""
    frames = cells.select(block, "t").distinct().withColumn("f", F.row_number().over(W.partitionBy(block).orderBy("t")) - 1)
    return cells.join(frames, [block, "t"]).groupBy(block, F.floor(F.col("f") / gop).cast("int").alias("gop")).agg(F.count_distinct("c").alias("m"))


def step_colors(cells: DataFrame, gop: int = LONGEST, block: str = "block") -> DataFrame:
    """(block, gop, c, n): how many steps of a group of pictures take a colour; a pixel's first frame is a step."""
    frames = cells.select(block, "t").distinct().withColumn("f", F.row_number().over(W.partitionBy(block).orderBy("t")) - 1)
    c = cells.join(frames, [block, "t"]).withColumn("gop", F.floor(F.col("f") / gop).cast("int"))
    before = F.lag("c").over(W.partitionBy(block, "gop", "x").orderBy("f"))
    return c.withColumn("p", before).where("p is null or p <> c").groupBy(block, "gop", "c").agg(F.count("*").alias("n"))


def pixel_process_bits(px: DataFrame, colors: DataFrame, color_bits: int = 8, block: str = "block") -> DataFrame:
    """(block, gop, huffman, rep, bits): independent pixels in their best representation, colours by a Huffman code where that pays.

    The code pays where its table and the whole bits of its colours are below those of a fixed width.
    """
    from jumpmark.functions import coding

    c = color_bits
    average = colors.groupBy(block, "gop").agg(coding.average_bits(F.col("n")).alias("average"))
    size = colors.groupBy(block, "gop").agg(F.count("*").alias("m"), F.sum("n").alias("k"))
    overhead = F.col("m") * (c + 5) + F.greatest(2 * F.length(F.bin("m")) - 1, F.lit(1))
    gate = average.join(size, [block, "gop"]).withColumn("overhead", overhead)
    pays = (F.col("m") > 1) & (F.col("overhead") + F.floor(F.col("average") * F.col("k")) < c * F.col("k"))
    gate = gate.select(block, "gop", pays.alias("huffman"), F.when(pays, F.col("overhead")).otherwise(0).alias("overhead"), F.when(pays, F.col("average")).otherwise(float(c)).alias("a"))
    d, n, r = F.length(F.bin("r")), F.col("n"), F.col("r")
    marks = F.floor(n * F.col("a"))
    each = px.join(gate, [block, "gop"]).select(block, "gop", "huffman", "overhead", F.floor(r * c * F.col("a") / c).alias("L1"), (d + n * d + marks).alias("L2"), (r + marks).alias("L3"), (d + binomial_bits(r, n) + marks).alias("L4"))
    g = each.groupBy(block, "gop", "huffman", "overhead").agg(*(F.sum(f"L{i}").alias(f"L{i}") for i in range(1, 5)))
    best = F.array_min(F.array(*(F.struct(F.col(f"L{i}").cast("long").alias("bits"), F.lit(i).alias("rep")) for i in range(1, 5))))
    return g.select(block, "gop", "huffman", best["rep"].alias("rep"), (8 + F.col("overhead") + best["bits"]).cast("long").alias("bits"))
