"""Connected components by alternating large and small stars over edge tables; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import stored


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (u, v) as few as join what they join: from each node to the smallest one it reaches among them."""
    above: dict[int, int] = {}

    def top(k: int) -> int:
        root = k
        while above.setdefault(root, root) != root:
            root = above[root]
        while above[k] != root:
            above[k], k = root, above[k]
        return root

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                above[max(p, q)] = min(p, q)
    nodes = [k for k in list(above) if top(k) != k]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(k) for k in nodes], pa.int64())], ["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node but roots has one edge, and it leads to a root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return per.where("below > 1 or (below > 0 and above > 0)").limit(1).isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b: long); root is the smallest node reachable.

    Each task first joins what its own links join. Then each round replaces edges by edges to the smallest neighbour seen,
    first for larger neighbours, then for smaller ones; the rounds needed grow with the logarithm of the longest path. Each
    round is written to the shared folder.
    """
    # edges go from the larger node u to the smaller v
    own = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(own.mapInArrow(forest, "u long, v long"))
    for _ in range(max_rounds):
        if _stars(edges):
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table, so that the edges of a node that very many have in common can be split over tasks
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stored(small)
    else:
        raise RuntimeError("components did not converge")
    return edges.withColumnsRenamed({"u": "node", "v": "root"}).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
