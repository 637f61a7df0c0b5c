"""Best-fit packing into bins of several permitted lengths.

Rows are dealt evenly into shards of about SHARD_ROWS, equal rows too, so no task sees more however large the corpus is.
In a shard, pieces go from long to short into the open bin they leave least room in. Where none takes a piece, a bin is
opened, of the permitted size that costs least for each token: what a bin of that size could hold is found by filling it
from the lengths that are still to be placed, longest first, and its cost is that of the smallest size which holds this
(tokens, attention that grows with the square of the length, and a fixed part).
So the sizes compete for the same pieces, and small bins are opened where large ones would stay half empty. At the end
each bin is downsized to the smallest permitted size that holds its contents. A shard is also packed with the largest
size alone, and the cheaper of the two packings stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumpmark.llm.common import SPACE_WORD

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs beside its capacity, in tokens; and the length at which attention costs a token as much as all else.
OVERHEAD, ATTENTION = 16, 1 << 14
SHARD_ROWS = 50_000


class Remaining:
    """The lengths still to be placed: how many of each, and a bit mask of those there are."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        self.mask = 0
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
            self.mask |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens that would go into so much room, the longest pieces that fit first; nothing is taken."""
        used, mask = 0, self.mask
        while room:
            mask &= (1 << (room + 1)) - 1
            n = mask.bit_length() - 1
            if n <= 0:
                break
            k = min(self.count[n], room // n)
            used += k * n
            room -= k * n
            mask &= ~(1 << n)
        return used


def smallest(capacities: tuple[int, ...], used: int) -> int:
    return next(c for c in capacities if c >= used)


def bin_cost(capacity: int, overhead: int = OVERHEAD) -> float:
    """What a sequence of a permitted length costs: its tokens, attention among them, and a fixed part."""
    return capacity + capacity * capacity / ATTENTION + overhead


def open_size(item: int, remaining: Remaining, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted size to open for an item (already taken from what remains): least cost for each token it could hold."""
    best = None
    for c in capacities:
        if c >= item:
            used = item + remaining.fill(c - item)
            cost = (bin_cost(smallest(capacities, used), overhead) / used, c)
            best = cost if best is None or cost < best else best
    return best[1]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, joint: bool = True) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (lengths from 1 to the largest capacity, longest first), and each bin's final size.

    Without joint only the largest size is opened.
    """
    capacities = tuple(sorted(capacities))
    remaining, room_mask, by_room = Remaining(lengths), 0, [[] for _ in range(capacities[-1] + 1)]
    bins, offsets, used = [], [], []
    for n in lengths:
        remaining.take(n)
        fitting = room_mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                room_mask ^= 1 << room
        else:
            b, room = len(used), open_size(n, remaining, capacities, overhead) if joint else capacities[-1]
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            room_mask |= 1 << room
    return bins, offsets, [smallest(capacities, u) for u in used]


def pack_best(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The cheaper of the packings with all sizes and with the largest alone; of equal ones the former."""
    return min((pack(lengths, capacities, overhead, joint) for joint in (True, False)), key=lambda p: sum(bin_cost(c, overhead) for c in p[2]))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: key, piece, start, n_tokens (white-space words), shard, bin, offset, capacity, bin_used.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. Null text and text without
    words give one piece of no tokens without a bin. Repeated rows are packed each. Columns beside key and text are not
    looked at; a null key is packed as any other. Equal lengths go in order of key (nulls first), then piece.
    """
    lengths = docs.select(F.col(key).alias("k"), F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("n"))
    shards = max(1, -(-docs.count() // shard_rows))
    top = max(capacities)
    key_type = docs.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "n"], kind="stable", na_position="first").reset_index(drop=True)
        pieces = np.maximum(1, -(-pdf["n"].to_numpy() // top))
        out = pdf.loc[np.repeat(np.arange(len(pdf)), pieces)].reset_index(drop=True)
        out["piece"] = np.concatenate([np.arange(p) for p in pieces]) if len(pieces) else []
        out["start"] = out["piece"] * top
        out["n_tokens"] = np.minimum(top, out["n"] - out["start"])
        out = out.iloc[np.argsort(-out["n_tokens"].to_numpy(), kind="stable")].reset_index(drop=True)
        some = int((out["n_tokens"] > 0).sum())
        bins, offsets, sizes = pack_best(out["n_tokens"].iloc[:some].tolist(), capacities, overhead)
        b = np.array(bins, dtype=np.int64)
        used = np.bincount(b, weights=out["n_tokens"].iloc[:some], minlength=len(sizes)).astype(np.int64) if some else np.zeros(0, np.int64)
        rest = [None] * (len(out) - some)
        for name, values in (("bin", b), ("offset", offsets), ("capacity", np.array(sizes, dtype=np.int64)[b]), ("bin_used", used[b])):
            out[name] = pd.array([*map(int, values), *rest], dtype="Int64")
        return out[["k", "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity", "bin_used"]]

    # a row's place in its file counts too, so that equal rows are spread
    dealt = lengths.withColumn("shard", F.pmod(F.xxhash64("k", "n", F.monotonically_increasing_id()), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(one, f"k {key_type}, piece long, start long, n_tokens long, shard long, bin long, offset long, capacity long, bin_used long")
    return packed.withColumnRenamed("k", key)
