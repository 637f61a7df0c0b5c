"""Videos as block files: a Spark data source that writes one file a row and reads each file's blocks.

A file is a header of 24 bytes, then a piece for each block: its place, process and sizes, and the payload. Blocks have their
length, so a reader can skip; one task reads a file. Paths may be any that pyarrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from jumpmark.operators.codec import PROCESSES, decode_block
from jumpmark.sources.stores import write_header

SUFFIX = ".ppv"
#: Of a block: number, group, pixels, frames, process, bytes of the payload.
PIECE = ">QIIHBI"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pack(blocks: Iterator[tuple[int, int, int, int, str, bytes]], shape: tuple[int, int, int]) -> bytes:
    """A file of blocks (number, group, pixels, frames, process, payload); shape: columns, rows, frames."""
    columns, rows, frames = shape
    body = b"".join(struct.pack(PIECE, b, g, n, r, PROCESSES.index(p), len(data)) + data for b, g, n, r, p, data in blocks)
    return write_header((0, columns, rows, frames, 8, 8, 0, 0, len(body), 0)) + body


def unpack(data: bytes) -> Iterator[tuple[int, int, int, int, str, bytes]]:
    """The blocks of a file; ValueError where it is none or ends early."""
    if data[:4] != b"PPV1":
        raise ValueError("no block video")
    at, size = 24, struct.calcsize(PIECE)
    while at < len(data):
        if at + size > len(data):
            raise ValueError("file ends early")
        b, g, n, r, p, length = struct.unpack(PIECE, data[at : at + size])
        at += size + length
        if at > len(data):
            raise ValueError("file ends early")
        yield b, g, n, r, PROCESSES[p], data[at - length : at]


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


@dataclass
class _File(InputPartition):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> _Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done = []
        for row in rows:
            name = f"{folder.rstrip('/')}/{row['name']}{SUFFIX}"
            with system.open_output_stream(name + ".tmp") as out:
                out.write(bytes(row["content"]))
            system.move(name + ".tmp", name)  # a task that runs again replaces its file as a whole
            done.append(name)
        return _Written(done)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = _open(self.path)
        return [_File(f.path) for f in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path) if f.path.endswith(SUFFIX)]

    def read(self, partition: _File):
        system, _ = _open(self.path)
        with system.open_input_stream(partition.path) as f:
            data = f.read()
        name = partition.path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
        for b, g, n, r, process, payload in unpack(data):
            yield name, b, g, n, r, process, payload


class BlockVideo(DataSource):
    """format("blockvideo"): writes (name string, content binary), reads (name, block, gop, n, r, process, payload)."""

    @classmethod
    def name(cls) -> str:
        return "blockvideo"

    def schema(self) -> str:
        return "name string, block long, gop int, n int, r int, process string, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def files(payloads: DataFrame, video: str) -> DataFrame:
    """(name, content) of payloads (video, block, gop, n, r, process, payload, rows, columns): a file for each video, blocks in order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "gop"])
        blocks = [(int(b), int(g), int(n), int(r), p, bytes(d)) for b, g, n, r, p, d in pdf[["block", "gop", "n", "r", "process", "payload"]].itertuples(index=False)]
        return pd.DataFrame([(str(pdf[video].iloc[0]), pack(iter(blocks), (int(pdf["columns"].iloc[0]), int(pdf["rows"].iloc[0]), int(pdf["r"].sum()))))], columns=["name", "content"])

    return payloads.groupBy(video).applyInPandas(one, "name string, content binary")


def cells(blocks: DataFrame) -> DataFrame:
    """(name, block, gop, x, k, c) of what the source reads."""

    def run(batches):
        for pdf in batches:
            out = [(name, b, g, x, k, c) for name, b, g, n, r, p, d in pdf[["name", "block", "gop", "n", "r", "process", "payload"]].itertuples(index=False) for x, seq in enumerate(decode_block(bytes(d), p, n, r)) for k, c in enumerate(seq)]
            yield pd.DataFrame(out, columns=["name", "block", "gop", "x", "k", "c"])

    return blocks.mapInPandas(run, "name string, block long, gop int, x int, k int, c int")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockVideo)
