"""Readers and writers: array volumes, container headers, JSON stores. Schemas are explicit."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "seq long, ts string, video_name string, codec_name string, quality_param string, input_size long, output_size long, compression_ratio double, bitrate_kbps double, bits_per_pixel double, psnr double, ssim double, encode_time double, decode_time double, encode_fps double, decode_fps double, width int, height int, n_frames int, duration double, success boolean, error string"
FEATURES = "block_id long, N int, r int, m int, n_pixels int, lambda_avg double, H_s double, rho_corr double, R_temp double, m_eff int, H_color double, N_trans int, color_dist map<string,double>, var_delta_tau double, mean_delta_tau double"
_CONFIG = "struct<threshold_H_s double, threshold_rho_high double, threshold_rho_low double, threshold_chi2 double, density_R1_max double, density_R4b_R2 double, density_R4a_min double>"
GRID_RESULT = f"best_cost double, n_evaluated long, total_time_sec double, best_config {_CONFIG}, top_k array<struct<total double, config {_CONFIG}>>"
_MATRIX = "struct<matrix array<array<long>>, labels array<string>>"
CONFUSION = f"A {_MATRIX}, B {_MATRIX}, C {_MATRIX}"
#: Fixed layout of the container's header, big-endian, 24 bytes: magic, version, color, rows, columns, frames and so on.
HEADER = ">4sBBHHHBBHHIH"


def as_gray(volume: np.ndarray) -> np.ndarray:
    """Frames of three channels (red, green, blue) as one; others as they are."""
    return np.floor(volume @ np.array([0.299, 0.587, 0.114])).astype(np.int64) if volume.ndim == 4 else volume


def resized(volume: np.ndarray, size: tuple[int, int] | None) -> np.ndarray:
    """Frames of size (rows, columns), each cell the nearest one of the original."""
    if size is None or volume.shape[1:3] == tuple(size):
        return volume
    y, x = (np.arange(n) * have // n for n, have in zip(size, volume.shape[1:3], strict=True))
    return volume[:, y][:, :, x]


def volumes(spark: SparkSession, path: str, max_frames: int | None = None, pattern: str = "*.npy", size: tuple[int, int] | None = None, fps: float = 30.0) -> DataFrame:
    """Cells (video_id, t, y, x, c, fps) of array files of shape (frames, rows, columns[, 3]), as gray; one task reads a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                v = resized(as_gray(np.load(io.BytesIO(content), allow_pickle=False)[:max_frames]), size)
                for t in range(v.shape[0]):
                    y, x = np.indices(v[t].shape)
                    yield pd.DataFrame({"video_id": name.rsplit("/", 1)[-1], "t": t, "y": y.ravel(), "x": x.ravel(), "c": v[t].ravel().astype(np.int64), "fps": fps})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "video_id string, t int, y int, x int, c int, fps double")


def palette_table(spark: SparkSession, colors: list[tuple[int, int, int]], path: str) -> DataFrame:
    """A palette (idx, r, g, b) written as Parquet and read again."""
    spark.createDataFrame([(i, *c) for i, c in enumerate(colors)], "idx int, r int, g int, b int").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("idx int, r int, g int, b int").parquet(path).orderBy("idx")


def headers(spark: SparkSession, path: str, pattern: str = "*.ppv") -> DataFrame:
    """(path, magic, version, fields): the first 24 bytes of container files; a wrong magic gives null fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, head in zip(pdf["path"], pdf["head"], strict=True):
                ok = len(head) >= 24 and head[:4] == b"PPV1"
                f = struct.unpack(HEADER, head[:24]) if ok else None
                out.append((name, head[:4].decode("latin-1"), f[1] if f else None, list(f[2:]) if f else None))
            yield pd.DataFrame(out, columns=["path", "magic", "version", "fields"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.substring("content", 1, 24).alias("head"))
    return files.mapInPandas(run, "path string, magic string, version int, fields array<long>")


def write_header(fields: tuple[int, ...], version: int = 1) -> bytes:
    return struct.pack(HEADER, b"PPV1", version, *fields)


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def confusion_rows(store: DataFrame) -> DataFrame:
    """(dim, act, pred, n) of a store of matrices by dimension."""
    each = store.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"{d}.matrix").alias("m")) for d in "ABC"))).alias("e")).select("e.dim", F.posexplode("e.m").alias("act", "row"))
    return each.select("dim", "act", F.posexplode("row").alias("pred", "n"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def media(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("avi", "mp4", "mkv", "mov", "webm", "m4v", "wmv", "y4m")) -> DataFrame:
    """Media files of a folder by suffix, either case, sorted by name."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes)).orderBy("path")


def probe(df: DataFrame, column: str = "json") -> DataFrame:
    """Width, height, rate, frames and duration of probe output; frames fall back to rate times duration."""
    s = F.from_json(column, "streams array<struct<width int, height int, r_frame_rate string, nb_frames string, duration string>>")["streams"][0]
    rate = F.try_divide(F.split_part(s["r_frame_rate"], F.lit("/"), F.lit(1)).cast("double"), F.split_part(s["r_frame_rate"], F.lit("/"), F.lit(2)).cast("double"))
    duration = s["duration"].try_cast("double")
    return df.select(s["width"].alias("width"), s["height"].alias("height"), rate.alias("fps"), F.coalesce(s["nb_frames"].try_cast("int"), F.floor(rate * duration).cast("int")).alias("n_frames"), duration.alias("duration"))


#: Fixed layout of a block container: magic, version (2 bytes) and lengths (4 bytes) big-endian; the header little-endian
#: (columns, rows, frames, rate, block side, block frames, colours).
BLOCK_MAGIC, BLOCK_HEADER = b"LMDV", "<HHIfBBH"


def parse_container(data: bytes) -> tuple[int, tuple, list[tuple[int, int, int]], list[bytes]]:
    """Version, header fields, palette and block payloads; ValueError where the bytes are no container or end early."""
    if data[:4] != BLOCK_MAGIC:
        raise ValueError("no block container")
    at = 6

    def piece() -> bytes:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("container ends early")
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            raise ValueError("container ends early")
        return data[at - n : at]

    header, colors = piece(), piece()
    n_blocks = int.from_bytes(data[at : at + 4], "big")
    at += 4
    blocks = [piece() for _ in range(n_blocks)]
    n = int.from_bytes(colors[:2], "little")
    palette = [tuple(colors[2 + 3 * i : 5 + 3 * i]) for i in range(n)]
    return int.from_bytes(data[4:6], "big"), struct.unpack(BLOCK_HEADER, header[: struct.calcsize(BLOCK_HEADER)]), palette, blocks


def build_container(header: tuple, palette: list[tuple[int, int, int]], blocks: list[bytes], version: int = 1) -> bytes:
    sized = lambda b: len(b).to_bytes(4, "big") + b
    colors = len(palette).to_bytes(2, "little") + bytes(v for c in palette for v in c)
    return BLOCK_MAGIC + version.to_bytes(2, "big") + sized(struct.pack(BLOCK_HEADER, *header)) + sized(colors) + len(blocks).to_bytes(4, "big") + b"".join(map(sized, blocks))


def containers(spark: SparkSession, path: str, pattern: str = "*.lmd") -> DataFrame:
    """(path, block, columns, rows, frames, fps, payload, error): a row for each block of container files.

    A file that cannot be read gives one row with null fields and the reason; one task reads a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "block", "columns", "rows", "frames", "fps", "payload", "error"]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    _, head, _, blocks = parse_container(bytes(content))
                    rows = [(name, i, *head[:4], b, None) for i, b in enumerate(blocks)]
                except (ValueError, struct.error) as e:
                    rows = [(name, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, block int, columns int, rows int, frames long, fps double, payload binary, error string")
