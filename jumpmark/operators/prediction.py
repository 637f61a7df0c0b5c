"""Neighbour predictions of cells and their inversion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MODES = ("left", "top", "dc", "paeth", "med", "time")


def neighbours(cells: DataFrame, key: list[str]) -> DataFrame:
    """cells (key, t, y, x, c) with l, u, ul (left, above, above left) and b (the frame before); 0 outside the block."""
    row, col = W.partitionBy(*key, "t", "y").orderBy("x"), W.partitionBy(*key, "t", "x").orderBy("y")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = cells.withColumn("l", zero(F.lag("c").over(row))).withColumn("u", zero(F.lag("c").over(col)))
    out = out.withColumn("ul", zero(F.lag("l").over(col)))
    return out.withColumn("b", zero(F.lag("c").over(W.partitionBy(*key, "y", "x").orderBy("t"))))


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """The neighbour nearest to left + up - corner; left, then up, wins ties."""
    guess = left + up - corner
    a, b, c = F.abs(guess - left), F.abs(guess - up), F.abs(guess - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def med(left: Column, up: Column, corner: Column) -> Column:
    """Median of left, up and left + up - corner."""
    lo, hi = F.least(left, up), F.greatest(left, up)
    return F.when(corner >= hi, lo).when(corner <= lo, hi).otherwise(left + up - corner)


def predictions() -> dict[str, Column]:
    left, up, corner = F.col("l"), F.col("u"), F.col("ul")
    return {"left": left, "top": up, "dc": F.shiftright(left + up, 1), "paeth": paeth(left, up, corner), "med": med(left, up, corner), "time": F.col("b")}


def residuals(cells: DataFrame, key: list[str]) -> DataFrame:
    """cells with a column res_<mode> for each mode: the value less its prediction, mod 256."""
    near = neighbours(cells, key)
    return near.select(*cells.columns, *((F.col("c") - p).bitwiseAND(F.lit(255)).alias(f"res_{m}") for m, p in predictions().items()))


def restore_sums(res: DataFrame, key: list[str], mode: str) -> DataFrame:
    """Values from residuals where the prediction is one neighbour: running sums mod 256 along a row, a column or time."""
    over = {"left": ([*key, "t", "y"], "x"), "top": ([*key, "t", "x"], "y"), "time": ([*key, "y", "x"], "t")}[mode]
    w = W.partitionBy(*over[0]).orderBy(over[1]).rowsBetween(W.unboundedPreceding, 0)
    return res.withColumn("c", F.sum(f"res_{mode}").over(w).bitwiseAND(F.lit(255)).cast("int"))


def _predict(mode: str, left: int, up: int, corner: int) -> int:
    if mode == "dc":
        return (left + up) >> 1
    if mode == "med":
        return sorted((left, up, left + up - corner))[1]
    guess = left + up - corner
    return min((left, up, corner), key=lambda v: abs(guess - v))


def _restore_frame(res: np.ndarray, mode: str) -> np.ndarray:
    out = np.zeros((res.shape[0] + 1, res.shape[1] + 1), np.int64)
    for y in range(res.shape[0]):
        for x in range(res.shape[1]):
            out[y + 1, x + 1] = (res[y, x] + _predict(mode, int(out[y + 1, x]), int(out[y, x + 1]), int(out[y, x]))) & 255
    return out[1:, 1:]


def restore_frames(res: DataFrame, key: list[str], mode: str) -> DataFrame:
    """Values from residuals where the prediction needs two neighbours or more: cell by cell, a frame of a block at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        shape = (pdf["y"].nunique(), pdf["x"].nunique())
        pdf["c"] = _restore_frame(pdf[f"res_{mode}"].to_numpy(np.int64).reshape(shape), mode).ravel()
        return pdf[[*key, "t", "y", "x", "c"]]

    kinds = ", ".join(f"{c} {res.schema[c].dataType.simpleString()}" for c in [*key, "t", "y", "x"])
    return res.select(*key, "t", "y", "x", f"res_{mode}").groupBy(*key, "t").applyInPandas(one, f"{kinds}, c int")


def adaptive_windows(cells: DataFrame, block: str = "block", least: int = 4, most: int = 128, color_bits: int = 8) -> DataFrame:
    """(block, t0, t1, m, mean_jumps, bits): greedy windows in time, each as long as makes its description shortest.

    A window's description is its palette, a presence vector per colour and the trajectories' colour indices. From a
    window's start the frames of each colour's first appearance and the jumps per frame are enough to size every end, so a
    block is one table of frames by place; blocks are independent.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="x", values="c", aggfunc="first").sort_index()
        grid, times = wide.to_numpy(), wide.index.to_numpy()
        jumps = np.concatenate([[0], (grid[1:] != grid[:-1]).sum(axis=1)]) if len(grid) else np.zeros(0, int)
        rows = [(pdf[block].iloc[0], *w) for w in _windows(grid, jumps, least, most, color_bits)]
        out = pd.DataFrame(rows, columns=[block, "i", "j", "m", "mean_jumps", "bits"])
        return out.assign(t0=times[out["i"]], t1=times[out["j"] - 1])[[block, "i", "j", "t0", "t1", "m", "mean_jumps", "bits"]]

    kind = cells.schema[block].dataType.simpleString()
    return cells.select(block, "t", "x", "c").groupBy(block).applyInPandas(one, f"{block} {kind}, i int, j int, t0 long, t1 long, m int, mean_jumps double, bits double")


def _windows(grid: np.ndarray, jumps: np.ndarray, least: int, most: int, color_bits: int) -> Iterator[tuple]:
    frames, places = grid.shape if grid.size else (0, 0)
    at = 0
    while at < frames:
        span = np.arange(min(least, frames - at), min(most, frames - at) + 1)
        seen: set = set()
        distinct = []
        for row in grid[at : at + span[-1]]:
            seen.update(row.tolist())
            distinct.append(len(seen))
        m = np.array(distinct)[span - 1]
        inside = np.concatenate([[0], np.cumsum(jumps[at + 1 : at + span[-1]])])[span - 1]
        mean = inside / places + 1
        index_bits = np.maximum(1, np.ceil(np.log2(np.maximum(m, 2))))
        bits = m * color_bits + m * span + places * mean * index_bits
        crowded = np.flatnonzero((m > 128) & (span > least))
        if len(crowded):
            bits = bits[: crowded[0] + 1]
        k = int(np.argmin(bits))
        yield at, at + int(span[k]), int(m[k]), float(mean[k]), float(bits[k])
        at += int(span[k])


def boundary_bits(windows: DataFrame, block: str = "block") -> DataFrame:
    """Bits of the boundaries: gamma codes of the number of windows and of each one's length."""
    gamma = lambda n: 2 * F.floor(F.log2(n)) + 1
    return windows.groupBy(block).agg(F.count("*").alias("windows"), F.sum(gamma(F.col("j") - F.col("i"))).alias("own")).select(block, "windows", (gamma(F.col("windows")) + F.col("own")).alias("bits"))


def texture(cells: DataFrame, block: str = "block") -> DataFrame:
    """Per block and frame (cells t, y, x, c): 0.3 of the colour diversity (of 256 at most) and 0.7 of the share of unequal neighbours."""
    right, down = F.lead("c").over(W.partitionBy(block, "t", "y").orderBy("x")), F.lead("c").over(W.partitionBy(block, "t", "x").orderBy("y"))
    e = cells.withColumns({"r": right, "d": down})
    edges = F.count("r") + F.count("d")
    differ = F.count_if(F.col("c") != F.col("r")) + F.count_if(F.col("c") != F.col("d"))
    diversity = F.count_distinct("c") / F.least(F.count("*"), F.lit(256))
    return e.groupBy(block, "t").agg(F.least(0.3 * diversity + 0.7 * F.when(edges > 0, differ / edges).otherwise(0.0), F.lit(1.0)).alias("texture"))
