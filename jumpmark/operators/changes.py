"""Change detection: what changed, where, when, and to which state. One window per block key; never a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def changed(cells: DataFrame, key: list[str], t: str = "t", c: str = "c", first_counts: bool = True) -> DataFrame:
    """cells with b: whether the state differs from the one before (the first instant counts as first_counts says)."""
    w = W.partitionBy(*key).orderBy(t)
    return cells.withColumn("b", F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(first_counts)))


def jumps(cells: DataFrame, block: str = "block", x: str = "x") -> DataFrame:
    """Changes after the first instant, marked with the dense rank of the new colour in its block."""
    ranks = cells.select(block, "c").distinct().withColumn("mark", F.dense_rank().over(W.partitionBy(block).orderBy("c")) - 1)
    return changed(cells, [block, x], first_counts=False).where("b").join(ranks, [block, "c"]).select(block, "t", x, "mark")


def pixel_structs(cells: DataFrame, key: list[str]) -> DataFrame:
    """Per pixel: number of jumps, jump times and the colours taken, in order of time."""
    b = changed(cells, key).where("b").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("j"))
    return b.select(*key, F.size("j").alias("n"), F.col("j.t").alias("dates"), F.col("j.c").alias("colors"))


def mask_changes(cells: DataFrame, key: list[str], color: int, block: str = "block") -> DataFrame:
    """Times at which the mask of one colour changes anywhere in a block."""
    mask = cells.withColumn("in_mask", F.col("c") == color)
    w = W.partitionBy(*key).orderBy("t")
    return mask.withColumn("ch", F.col("in_mask") != F.lag("in_mask").over(w)).where("ch").groupBy(block, "t").agg(F.count("*").alias("n_pixels"))


def state_entries(cells: DataFrame, key: list[str], block: str = "block") -> DataFrame:
    """How many pixels of a block enter a state at a time."""
    return changed(cells, key).where("b").groupBy(block, F.col("c").alias("state"), "t").agg(F.count("*").alias("n_entries"))


def rebuild(jump_rows: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """The step function of jump rows (key, t, c) on the times of grid (key, t): the last colour is carried forward."""
    w = W.partitionBy(*key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(jump_rows, [*key, "t"], "left").withColumn("c", F.last("c", ignorenulls=True).over(w))


def transitions(events: DataFrame, block: str = "block_id") -> DataFrame:
    """Consecutive differing marks (h to j) of a block's sequence, counted."""
    w = W.partitionBy(block).orderBy("t", "seq")
    return events.withColumn("h", F.lag("mark").over(w)).where("h <> mark").groupBy(block, "h", F.col("mark").alias("j")).agg(F.count("*").alias("n"))


def spans(events: DataFrame, block: str = "block_id") -> DataFrame:
    """Runs of equal marks (gaps and islands): first and last place, length."""
    w = W.partitionBy(block).orderBy("t", "seq")
    s = events.withColumn("new", F.coalesce((F.col("mark") != F.lag("mark").over(w)).cast("int"), F.lit(0)))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(block, "run", "mark").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def state_at(events: DataFrame, probes: DataFrame, block: str = "block_id") -> DataFrame:
    """As-of lookup: the last mark of a block at or before each probe time, by union and a last-value window."""
    e = events.select(block, "t", F.lit(0).alias("kind"), "seq", F.struct("mark").alias("s"))
    p = probes.select(block, "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("struct<mark:int>").alias("s"))
    w = W.partitionBy(block).orderBy("t", "kind", "seq").rowsBetween(W.unboundedPreceding, 0)
    return e.union(p).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("kind = 1").select(block, "t", F.col("s.mark").alias("mark"))
