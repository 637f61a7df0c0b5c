"""Byte-level tokenising for the Arrow operators: the same words as the column patterns of common, without regular expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII-lower-cases and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# bytes.split() without an argument splits on exactly the bytes 20 and 09 to 0D.


def alnum_words(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


def space_words(data: bytes) -> list[bytes]:
    return data.translate(LOWER).split()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about limit bytes (a single longer text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = b.column(text).cast(pa.large_binary()) if not pa.types.is_large_binary(b.column(text).type) else b.column(text)
        import pyarrow.compute as pc

        n = np.asarray(pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.cumsum(n) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def raw(b: pa.RecordBatch, text: str) -> list[bytes | None]:
    return b.column(text).cast(pa.large_binary()).to_pylist()
