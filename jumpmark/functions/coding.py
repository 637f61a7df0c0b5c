"""Entropy codes of groups: Huffman lengths and combinatorial ranks."""

from __future__ import annotations

import bisect
import heapq
from collections import Counter
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_lengths(freqs: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; ties go to the smaller symbol; a single symbol has length 1."""
    if len(freqs) == 1:
        return dict.fromkeys(freqs, 1)
    heap = [(n, s, (s,)) for s, n in sorted(freqs.items())]
    heapq.heapify(heap)
    out = dict.fromkeys(freqs, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], -1, a[2] + b[2]))
    return out


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    code, last, out = 0, 0, {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = format(code, f"0{n}b"), n
        code += 1
    return out


def encode(symbols: list[int], codes: dict[int, str]) -> str:
    return "".join(codes[s] for s in symbols)


def decode(bits: str, codes: dict[int, str]) -> list[int]:
    back, at, out = {v: k for k, v in codes.items()}, "", []
    for b in bits:
        at += b
        if at in back:
            out.append(back[at])
            at = ""
    return out


def huffman_table(counts: DataFrame, block: str = "block_id") -> DataFrame:
    """Code per block and symbol, from counts (block, mark, n); groups hold one row per symbol."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = canonical(code_lengths(dict(zip(pdf["mark"].astype(int), pdf["n"].astype(int), strict=True))))
        return pd.DataFrame({block: pdf[block].iloc[0], "mark": list(codes), "code": list(codes.values())})

    return counts.select(block, "mark", "n").groupBy(block).applyInPandas(one, f"{block} {counts.schema[block].dataType.simpleString()}, mark int, code string")


def colex_rank(positions: Column, r: int) -> Column:
    """Rank of a set of positions (sorted, below r) by co-lexicographic order: the sum of comb(p_i, i + 1), exact decimals.

    comb values come from a literal Pascal row per i, so sets are limited to r <= 60 or so.
    """
    rows = F.array(*(F.array(*(F.lit(comb(p, i + 1)).cast("decimal(38,0)") for p in range(r))) for i in range(r)))
    return F.aggregate(F.transform(positions, lambda p, i: F.get(F.get(rows, i), p)), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))


def lex_rank(positions: Column, r: int) -> Column:
    """Rank of a set of positions (sorted, below r) by lexicographic order: all sets less those that come after, less one."""
    n = F.size(positions)
    rows = F.array(*(F.array(*(F.lit(comb(p, i)).cast("decimal(38,0)") for p in range(r + 1))) for i in range(r + 1)))
    at = lambda p, i: F.get(F.get(rows, i), p)
    after = F.transform(positions, lambda p, i: at(r - 1 - p, n - i))
    return F.aggregate(after, (at(F.lit(r), n) - 1).cast("decimal(38,0)"), lambda a, x: (a - x).cast("decimal(38,0)"))


def lex_unrank(rank: int, n: int, r: int) -> list[int]:
    out, p = [], 0
    while len(out) < n:
        block = comb(r - 1 - p, n - len(out) - 1)
        if rank < block:
            out.append(p)
        else:
            rank -= block
        p += 1
    return out


def unranked(ranks: DataFrame, r: int) -> DataFrame:
    """ranks (rank, lex, n: decimals and size) with the sets both give, a batch at a time; exact integers."""

    def run(batches):
        for pdf in batches:
            pdf["colex_set"] = [colex_unrank(int(a), int(n), r) for a, n in zip(pdf["rank"], pdf["n"], strict=True)]
            pdf["lex_set"] = [lex_unrank(int(a), int(n), r) for a, n in zip(pdf["lex"], pdf["n"], strict=True)]
            yield pdf

    return ranks.mapInPandas(run, ranks.schema.simpleString()[7:-1].replace(":", " ") + ", colex_set array<int>, lex_set array<int>")


def colex_unrank(rank: int, n: int, r: int) -> list[int]:
    out = []
    for i in range(n, 0, -1):
        p = max(q for q in range(r) if comb(q, i) <= rank)
        out.append(p)
        rank -= comb(p, i)
    return out[::-1]


def unary(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("1"), n.cast("int")), F.lit("0"))


def rice(n: Column, k: int) -> Column:
    """Quotient by 2^k in unary, remainder in k bits; a Golomb code for a power of two."""
    return F.concat(unary(F.shiftright(n.cast("long"), k)), F.lpad(F.bin(n.cast("long") % (1 << k)), k, "0") if k else F.lit(""))


def omega(n: int) -> str:
    """Recursive Elias code of n >= 1."""
    out = "0"
    while n > 1:
        b = format(n, "b")
        out, n = b + out, len(b) - 1
    return out


def omega_decode(bits: str) -> int:
    n, at = 1, 0
    while bits[at] == "1":
        n, at = int(bits[at : at + n + 1], 2), at + n + 1
    return n


def fibonacci(n: int) -> str:
    """Zeckendorf code of n >= 1, closed by a second 1."""
    f = [1, 2]
    while f[-1] <= n:
        f.append(f[-1] + f[-2])
    out = ""
    for x in reversed(f[:-1]):
        out, n = ("1" if x <= n else "0") + out, n - x if x <= n else n
    return out.rstrip("0") + "1"


def fibonacci_decode(bits: str) -> int:
    f, total = [1, 2], 0
    while len(f) < len(bits):
        f.append(f[-1] + f[-2])
    return total + sum(x for x, b in zip(f, bits[:-1], strict=False) if b == "1")


#: Width of the arithmetic coder's interval, and its half and quarter.
_WIDE, _HALF, _QUARTER = 1 << 32, 1 << 31, 1 << 30


def _bounds(freqs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Symbols in order, and the sums of the counts below each (one more entry than symbols)."""
    order = sorted(freqs)
    sums = [0]
    for s in order:
        sums.append(sums[-1] + freqs[s])
    return order, sums


def average_bits(counts: Column) -> Column:
    """The bits of a symbol under the Huffman code of a group's counts: an aggregate over a row for each symbol."""

    @F.pandas_udf("double")
    def over(n: pd.Series) -> float:
        freqs = dict(enumerate(n.astype(int)))
        lengths = code_lengths(freqs)
        return float(sum(freqs[s] * lengths[s] for s in freqs) / sum(freqs.values()))

    return over(counts)


def arithmetic_encode(symbols: list[int], freqs: dict[int, int]) -> str:
    """Bits of a sequence by its symbols' counts (together below 2^30): an interval of 32 bits is narrowed by each symbol, and its
    settled leading bits go out at once, so the work is in proportion to the sequence."""
    order, sums = _bounds(freqs)
    at = {s: i for i, s in enumerate(order)}
    low, high, waiting, out = 0, _WIDE - 1, 0, []

    def settle(bit: str) -> None:
        nonlocal waiting
        out.append(bit + ("1" if bit == "0" else "0") * waiting)
        waiting = 0

    for s in symbols:
        span, i = high - low + 1, at[s]
        low, high = low + span * sums[i] // sums[-1], low + span * sums[i + 1] // sums[-1] - 1
        while True:
            if high < _HALF:
                settle("0")
            elif low >= _HALF:
                settle("1")
                low, high = low - _HALF, high - _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                waiting += 1
                low, high = low - _QUARTER, high - _QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
    waiting += 1
    settle("0" if low < _QUARTER else "1")
    return "".join(out)


def arithmetic_decode(bits: str, n: int, freqs: dict[int, int]) -> list[int]:
    """The n symbols that arithmetic_encode() wrote."""
    order, sums = _bounds(freqs)
    low, high, place, out = 0, _WIDE - 1, 32, []
    value = int(bits[:32].ljust(32, "0"), 2)
    for _ in range(n):
        span = high - low + 1
        i = bisect.bisect_right(sums, ((value - low + 1) * sums[-1] - 1) // span) - 1
        out.append(order[i])
        low, high = low + span * sums[i] // sums[-1], low + span * sums[i + 1] // sums[-1] - 1
        while True:
            if high < _HALF:
                off = 0
            elif low >= _HALF:
                off = _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                off = _QUARTER
            else:
                break
            low, high = 2 * (low - off), 2 * (high - off) + 1
            value = 2 * (value - off) + (bits[place : place + 1] == "1")
            place += 1
    return out


def round_trips(events: DataFrame, block: str = "block_id") -> DataFrame:
    """Per block: bits of the Huffman and the arithmetic code of its mark sequence, and whether both decode to it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = pdf.sort_values(["t", "seq"])["mark"].astype(int).tolist()
        freqs = dict(Counter(seq))
        codes = canonical(code_lengths(freqs))
        h = encode(seq, codes)
        bits = arithmetic_encode(seq, freqs)
        ok = decode(h, codes) == seq and arithmetic_decode(bits, len(seq), freqs) == seq
        return pd.DataFrame([(pdf[block].iloc[0], len(h), len(bits), ok)], columns=[block, "huffman_bits", "arithmetic_bits", "ok"])

    return events.select(block, "t", "seq", "mark").groupBy(block).applyInPandas(one, f"{block} {events.schema[block].dataType.simpleString()}, huffman_bits long, arithmetic_bits long, ok boolean")
