"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of ASCII-lower-cased text: digits, a-z and everything beyond ASCII (as a positive class, which Java matches much faster).
ALNUM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def store_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of this machine only where the session names none (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/jumpmark-checkpoints"
    return found.rstrip("/")


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{store_dir(spark)}/jumpmark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes that df has no such column (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def maybe_broadcast(df: DataFrame, n_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint only below a measured size; above it the join shuffles."""
    return F.broadcast(df) if n_bytes <= limit else df
