"""Description-length costs and their arg-min, as expressions on block features (N, r, m, H, n_trans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumpmark.functions.scalar import delta_bits, dictionary_bits, log2_comb

COLOR_MODES, TEMPORAL_MODES, TYPE_MODES = ("Ba", "Bb", "Bc", "Bd"), ("R1", "R2", "R3", "R4a", "R4b"), ("Aa", "Ab", "Ac", "Ad", "Ae")


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def color_costs() -> dict[str, Column]:
    """Sequential, uniform, Huffman and (approximate) Elias colour costs; 0 for no jumps or one colour."""
    lm, some = F.log2("m"), (F.col("N") > 0) & (F.col("m") > 1)
    costs = {"Ba": lm * (1 + _c("n_trans")), "Bb": _c("N") * lm, "Bc": _c("N") * _c("H") + dictionary_bits(F.col("m")), "Bd": _c("N") * (lm + 2 * F.log2(F.greatest(F.lit(1.0), lm)))}
    return {k: F.when(some, v).otherwise(0.0) for k, v in costs.items()}


def elias_exact(events: DataFrame, block: str = "block_id") -> DataFrame:
    return events.groupBy(block).agg(F.sum(delta_bits(F.col("mark") + 1)).cast("long").alias("bd_exact"))


def temporal_costs() -> dict[str, Column]:
    n, r, some = _c("N"), _c("r"), F.col("N") > 0
    zero = lambda c: F.when(some, c).otherwise(0.0)
    return {"R1": zero(F.log2(n + 1) + n * F.log2(r)), "R2": r * F.log2(n / r + 1), "R3": zero(n * F.log2(r)), "R4a": r, "R4b": zero(F.log2(n + 1) + log2_comb(F.col("r"), F.col("N")))}


def temporal_costs_exhaustive() -> dict[str, Column]:
    """The exhaustive chooser's variant: other R1, R2 and R3."""
    n, r, some = _c("N"), _c("r"), F.col("N") > 0
    return {"R1": n * F.log2(r), "R2": F.when(some, r * F.log2(n / r + 1)).otherwise(r), "R3": F.when(some, n * F.log2(r / n + 1)).otherwise(F.lit(float("inf"))), "R4a": r, "R4b": F.log2(n + 1) + log2_comb(F.col("r"), F.col("N"))}


def type_costs() -> dict[str, Column]:
    n, h, lm = _c("N"), _c("H"), F.log2("m")
    return {"Aa": n * lm, "Ab": F.lit(0.0), "Ac": n * h, "Ad": 0.8 * n * h, "Ae": _c("n_trans") * lm}


def best(costs: dict[str, Column]) -> Column:
    """struct(cost, ord, name) of the smallest cost; the first in order wins ties."""
    return F.array_min(F.array(*(F.struct(c.cast("double").alias("cost"), F.lit(i).alias("ord"), F.lit(k).alias("name")) for i, (k, c) in enumerate(costs.items()))))


def joint(temporal: dict[str, Column], color: dict[str, Column]) -> dict[str, Column]:
    return {f"{c}+{b}": tc + bc for c, tc in temporal.items() for b, bc in color.items()}


def uniform_lengths() -> dict[str, Column]:
    """Four uniform code lengths of a marked process."""
    n, r, lm = _c("N"), _c("r"), F.log2("m")
    l4 = F.when((F.col("N") == 0) | (F.col("N") == F.col("r")), F.log2(r) + n * lm).otherwise(F.log2(F.greatest(n, F.lit(1.0))) + log2_comb(F.col("r"), F.col("N")) + n * lm)
    return {"L1": r * lm, "L2": F.when(F.col("N") == 0, F.log2(r)).otherwise(F.log2(F.greatest(n, F.lit(1.0))) + n * (F.log2(r) + lm)), "L3": r + n * lm, "L4": l4}


def huffman_threshold() -> Column:
    """Jumps from which a Huffman dictionary pays; null for never."""
    gain = F.log2("m") - _c("H")
    return F.when(gain > 0, dictionary_bits(F.col("m")) / gain)


def process_type() -> Column:
    return F.when(F.col("N") == 0, "MARKED").when((F.col("m") <= 4) & (F.col("m_eff") >= F.col("m") - 1), "MONO").otherwise("MARKED")


def suggested_representation() -> Column:
    return F.when(F.col("N") == 0, "R1").when(F.col("N") < 50, "R2").otherwise("R4b")


def bandwidth_level(bits: Column, kbps: Column, fps: float = 30.0) -> Column:
    """0 (best) to 3: how often over the bandwidth a block's bits are, by factors of one, two and four."""
    need = bits * fps
    return F.when(need <= kbps * 1000, 0).when(need <= kbps * 2000, 1).when(need <= kbps * 4000, 2).otherwise(3)


def adapted(fields: dict[str, Column], level: Column) -> dict[str, Column]:
    """Method code fields for a level: colours coarser from 1, pixels from 2, sequential colours at 3."""
    return {
        "F": F.when(level >= 1, F.greatest(F.lit(1), fields["F"] - level)).otherwise(fields["F"]),
        "G": F.when(level >= 2, F.least(F.lit(3), fields["G"] + 1)).otherwise(fields["G"]),
        "B": F.when(level >= 3, 0).otherwise(fields["B"]),
    }


def hierarchical(counts: DataFrame, levels: int, block: str = "block_id", level_bits: int = 8, target: int = 1) -> DataFrame:
    """Costs of colours in levels, from counts (block, level, c, n): by each level's entropy and dictionary, uniform, sequential.

    downgraded: the entropy cost when only the first target levels are kept.
    """
    n = F.sum("n")
    per = counts.groupBy(block, "level").agg(n.alias("N"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("H"), (F.max("c") + 1).alias("m"))
    total = per.groupBy(block).agg(F.sum("N").alias("all"), F.collect_list(F.struct("level", "H", "m")).alias("l"))
    cost = lambda x: F.col("all") * x["H"] + x["m"] * (F.floor(F.log2(x["m"].cast("double"))) + 1)
    some = lambda keep: F.aggregate(F.filter("l", keep), F.lit(0.0), lambda a, x: a + cost(x))
    bits = F.col("all") * float(levels * level_bits)
    return total.select(block, some(lambda x: F.lit(True)).alias("huffman"), bits.alias("uniform"), (bits * 0.3).alias("sequential"), some(lambda x: x["level"] < target).alias("downgraded"))
