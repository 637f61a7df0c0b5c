"""python -m jumpmark COMMAND: queries of the catalogue, and videos to block files and back.

  query [--sf DIR] [--out DIR] [--explain] [NAME...]   run queries; without names, list them
  encode FOLDER OUT [--max-frames N]                   array files to block files
  decode FOLDER OUT                                    block files to a table of cells
  info FOLDER                                          blocks, processes and bytes of block files
  optimize [--sf DIR]                                  the ten best threshold configurations
  validate [--sf DIR]                                  accuracy of predictions
  benchmark                                            the test patterns' bits
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumpmark import registry
from jumpmark.plans import blocks, choices, payloads, reports, tables  # noqa: F401  register their queries
from jumpmark.plans.catalog import QUERIES
from jumpmark.sources import blockvideo, stores

SIDE = 8


def encoded(cells: DataFrame) -> DataFrame:
    """(name, content) of cells (video_id, t, y, x, c): blocks of SIDE x SIDE cells by their shortest process, a file a video.

    A block's number holds its video, its place and its width, which is smaller at the right edge.
    """
    names = cells.groupBy("video_id").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns")).orderBy("video_id")
    names = names.withColumn("video", F.monotonically_increasing_id())
    at = cells.join(F.broadcast(names), "video_id")  # a row a video
    by, bx = F.floor(F.col("y") / SIDE), F.floor(F.col("x") / SIDE)
    block = F.col("video") * (1 << 40) + by * (1 << 20) + bx * 16 + F.least(F.lit(SIDE), F.col("columns") - bx * SIDE)
    place = (F.col("y") % SIDE * SIDE + F.col("x") % SIDE).cast("int")
    coded = registry.codec("blocks").encode(at.select(block.cast("long").alias("block"), "t", place.alias("x"), "c"))
    own = coded.withColumn("video", F.floor(F.col("block") / (1 << 40))).join(F.broadcast(names), "video").drop("video").withColumnRenamed("video_id", "video")
    return blockvideo.files(own, "video")


def decoded(blocks_read: DataFrame) -> DataFrame:
    """(name, t, y, x, c) of what the block video source reads; frames are numbered on through a block's groups."""
    c = blockvideo.cells(blocks_read)
    place = F.col("block") % (1 << 40)
    by, bx, width = F.floor(place / (1 << 20)), F.floor(place % (1 << 20) / 16), place % 16
    return c.select("name", (F.col("gop") * 32 + F.col("k")).alias("t"), (by * SIDE + F.floor(F.col("x") / width)).cast("int").alias("y"), (bx * SIDE + F.col("x") % width).cast("int").alias("x"), "c")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jumpmark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("query", "encode", "decode", "info", "optimize", "validate", "benchmark"))
    p.add_argument("args", nargs="*")
    p.add_argument("--sf", default="/root/testdata/sf0.001", help="folder of the Parquet tables")
    p.add_argument("--out", help="write results as Parquet below this folder instead of showing them")
    p.add_argument("--max-frames", type=int)
    p.add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    if a.command == "query" and not a.args:
        print("\n".join(sorted(QUERIES)))
        return
    if len(a.args) < {"encode": 2, "decode": 2, "info": 1}.get(a.command, 0):
        p.error(f"{a.command} needs more folders")
    spark = SparkSession.builder.appName("jumpmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    blockvideo.register(spark)
    if a.command == "encode":
        encoded(stores.volumes(spark, a.args[0], a.max_frames)).write.format("blockvideo").option("path", a.args[1]).mode("append").save()
        return
    if a.command in ("decode", "info"):
        read = spark.read.format("blockvideo").option("path", a.args[0]).load()
        if a.command == "decode":
            decoded(read).write.mode("overwrite").parquet(a.args[1])
        else:
            read.groupBy("name", "process").agg(F.count("*").alias("blocks"), F.sum(F.length("payload")).alias("bytes")).orderBy("name", "process").show(truncate=False)
        return
    names = {"optimize": ["objective_topk"], "validate": ["accuracy_metrics", "validation_totals"], "benchmark": ["pattern_benchmark"]}.get(a.command, a.args)
    for name in names:
        df = QUERIES[name](spark, a.sf)
        if a.explain:
            df.explain("formatted")
        elif a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        else:
            df.show(20, truncate=False)


if __name__ == "__main__":
    main()
