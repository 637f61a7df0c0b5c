"""Payloads: marked jump sequences with their method code, and blocks of pixels; encoded and decoded a group at a time.

A group is a block, whose size does not grow with the table. Relational work (which representation is cheapest) stays in
columns; only the writing of bits is done in Python.
"""

from __future__ import annotations

from math import comb

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumpmark.functions.bits import BitReader, BitWriter, read_huffman, read_palette, read_symbol, write_huffman, write_palette
from jumpmark.functions.coding import colex_unrank

# marked sequences: header, counts, times by a representation, marks by a colour mode

TIMES, MARKS = ("R1", "R2", "R3", "R4a", "R4b"), ("Ba", "Bb", "Bc", "Bd")


def colex(places: list[int]) -> int:
    return sum(comb(p, i + 1) for i, p in enumerate(places))


def write_times(w: BitWriter, times: list[int], r: int, form: str) -> None:
    """Sorted times below r. R1: each; R2: a count a frame in unary; R3: gaps in gamma codes; R4a, R4b (distinct times): presence, combination."""
    d = max(1, (r - 1).bit_length())
    if form == "R1":
        for t in times:
            w.number(t, d)
    elif form == "R2":
        for t in range(r):
            w.raw("1" * times.count(t) + "0")
    elif form == "R3":
        for a, b in zip([0, *times], times, strict=False):
            w.gamma(b - a + 1)
    elif form == "R4a":
        w.raw("".join("1" if t in set(times) else "0" for t in range(r)))
    else:
        w.number(colex(times), (comb(r, len(times)) - 1).bit_length())


def read_times(b: BitReader, n: int, r: int, form: str) -> list[int]:
    d = max(1, (r - 1).bit_length())
    if form == "R1":
        return [b.number(d) for _ in range(n)]
    if form == "R2":
        out = []
        for t in range(r):
            while b.raw(1) == "1":
                out.append(t)
        return out
    if form == "R3":
        out, t = [], 0
        for _ in range(n):
            t += b.gamma() - 1
            out.append(t)
        return out
    if form == "R4a":
        return [t for t, x in enumerate(b.raw(r)) if x == "1"]
    return colex_unrank(b.number((comb(r, n) - 1).bit_length()), n, r)


def write_marks(w: BitWriter, marks: list[int], m: int, mode: str) -> None:
    """Ba: the first, then a flag whether each changes and its value if so; Bb: each; Bc: a Huffman code; Bd: delta codes."""
    width = (max(m, 2) - 1).bit_length()
    if mode == "Ba":
        for i, c in enumerate(marks):
            if i:
                w.raw("1" if c != marks[i - 1] else "0")
            if not i or c != marks[i - 1]:
                w.number(c, width)
    elif mode == "Bb":
        for c in marks:
            w.number(c, width)
    elif mode == "Bc":
        codes = write_huffman(w, marks)
        for c in marks:
            w.raw(codes[c])
    else:
        for c in marks:
            w.delta(c + 1)


def read_marks(b: BitReader, n: int, m: int, mode: str) -> list[int]:
    width = (max(m, 2) - 1).bit_length()
    if mode == "Bb":
        return [b.number(width) for _ in range(n)]
    if mode == "Bc":
        codes = read_huffman(b)
        return [read_symbol(b, codes) for _ in range(n)]
    if mode == "Bd":
        return [b.delta() - 1 for _ in range(n)]
    out: list[int] = []
    for _ in range(n):
        out.append(b.number(width) if not out or b.raw(1) == "1" else out[-1])
    return out


def encode_marked(times: list[int], marks: list[int], r: int, m: int, form: str, mode: str, code: int) -> tuple[bytes, dict[str, int]]:
    """Payload and the bits of its parts. Combinations need distinct times: R2 takes their place where they are not."""
    if form.startswith("R4") and len(set(times)) < len(times):
        form = "R2"
    w = BitWriter().number(code, 17).number(TIMES.index(form), 3).number(MARKS.index(mode), 2)
    w.number(len(times), 16).number(r, 16).number(m, 8)
    head = w.size
    write_times(w, times, r, form)
    temporal = w.size - head
    write_marks(w, marks, m, mode)
    return w.bytes(), {"header": head, "temporal": temporal, "color": w.size - head - temporal, "total": w.size}


def decode_marked(data: bytes) -> tuple[list[int], list[int]]:
    b = BitReader(data)
    b.number(17)
    form, mode = TIMES[b.number(3)], MARKS[b.number(2)]
    n, r, m = b.number(16), b.number(16), b.number(8)
    return read_times(b, n, r, form), read_marks(b, n, m, mode)


def marked_payloads(events: DataFrame, choice: DataFrame, r: int, m: int, block: str = "block_id") -> DataFrame:
    """(block, form, mode, header, temporal, color, total, payload) of events (block, t, seq, mark) by choice (block, form, mode, code)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        form, mode, code = pdf["form"].iloc[0], pdf["mode"].iloc[0], int(pdf["code"].iloc[0])
        data, size = encode_marked(pdf["t"].astype(int).tolist(), pdf["mark"].astype(int).tolist(), r, m, form, mode, code)
        return pd.DataFrame([(pdf[block].iloc[0], form, mode, *size.values(), data)], columns=[block, "form", "mode", *size, "payload"])

    kind = events.schema[block].dataType.simpleString()
    return events.select(block, "t", "seq", "mark").join(choice.select(block, "form", "mode", "code"), block).groupBy(block).applyInPandas(one, f"{block} {kind}, form string, mode string, header int, temporal int, color int, total int, payload binary")


def marked_rows(payloads: DataFrame, block: str = "block_id") -> DataFrame:
    """(block, i, t, mark) of payloads."""

    def run(batches):
        for pdf in batches:
            rows = [(b, i, t, c) for b, data in zip(pdf[block], pdf["payload"], strict=True) for i, (t, c) in enumerate(zip(*decode_marked(bytes(data)), strict=True))]
            yield pd.DataFrame(rows, columns=[block, "i", "t", "mark"])

    kind = payloads.schema[block].dataType.simpleString()
    return payloads.select(block, "payload").mapInPandas(run, f"{block} {kind}, i int, t int, mark int")


# blocks of pixels

PROCESSES = ("mono", "pp", "spatial", "markov")


def steps(seq: list[int]) -> list[int]:
    """Frames in which a pixel takes a colour, the first one among them."""
    return [k for k, c in enumerate(seq) if not k or c != seq[k - 1]]


def write_pixel(w: BitWriter, seq: list[int], form: int, c: int) -> None:
    """1: every colour; 2: times and colours; 3: a bit a frame and colours; 4: a combination and colours."""
    r, at = len(seq), steps(seq)
    d = r.bit_length()
    if form == 1:
        for v in seq:
            w.number(v, c)
        return
    if form == 3:
        w.raw("".join("1" if k in set(at) else "0" for k in range(r)))
    else:
        w.number(len(at), d)
        if form == 4:
            w.number(colex(at), (comb(r, len(at)) - 1).bit_length())
    for k in at:
        if form == 2:
            w.number(k, d)
        w.number(seq[k], c)


def read_pixel(b: BitReader, r: int, form: int, c: int) -> list[int]:
    d = r.bit_length()
    if form == 1:
        return [b.number(c) for _ in range(r)]
    if form == 2:
        pairs = [(b.number(d), b.number(c)) for _ in range(b.number(d))]
    elif form == 3:
        at = [k for k, x in enumerate(b.raw(r)) if x == "1"]
        pairs = [(k, b.number(c)) for k in at]
    else:
        n = b.number(d)
        at = colex_unrank(b.number((comb(r, n) - 1).bit_length()), n, r)
        pairs = [(k, b.number(c)) for k in at]
    return spread(pairs, r)


def spread(pairs: list[tuple[int, int]], r: int) -> list[int]:
    out: list[int] = []
    for (k, v), (end, _) in zip(pairs, [*pairs[1:], (r, 0)], strict=True):
        out += [v] * (end - k)
    return out


def _pattern(seq: list[int]) -> str:
    at = set(steps(seq))
    return "".join("1" if k in at else "0" for k in range(len(seq)))


def encode_block(pixels: list[list[int]], process: str, c: int = 8) -> tuple[bytes, int]:
    """Payload and bits of pixels (each a sequence of colours, all of one length) as one colour, pixels of one form, a dominant pattern, or transitions."""
    w = BitWriter()
    if process == "mono":
        return (w.number(0, 7).number(pixels[0][0], c)).bytes(), w.size
    if process == "pp":
        sizes = []
        for form in (1, 2, 3, 4):
            t = BitWriter()
            for seq in pixels:
                write_pixel(t, seq, form, c)
            sizes.append(t.size)
        form = sizes.index(min(sizes)) + 1
        w.number(1, 6).number(form - 1, 2)
        for seq in pixels:
            write_pixel(w, seq, form, c)
    elif process == "spatial":
        patterns = [_pattern(s) for s in pixels]
        count = {p: patterns.count(p) for p in patterns}
        top = max(count, key=lambda p: (count[p], p))
        w.number(2, 8).raw(top).gamma(top.count("1"))
        for seq, p in zip(pixels, patterns, strict=True):
            w.raw("1" if p == top else "0")
            if p == top:
                for k in steps(seq):
                    w.number(seq[k], c)
            else:
                write_pixel(w, seq, 4, c)
    else:
        pairs = sorted({(a, b) for seq in pixels for a, b in zip(seq, seq[1:], strict=False) if a != b})
        width = max(1, (len(pairs) - 1).bit_length())
        w.number(3, 7).gamma(len(pairs)).raw("0")
        for a, b in pairs:
            w.number(a, c).number(b, c)
        for seq in pixels:
            w.number(seq[0], c)
            for a, b in zip(seq, seq[1:], strict=False):
                w.raw("1" if a != b else "0")
                if a != b:
                    w.number(pairs.index((a, b)), width)
    return w.bytes(), w.size


def decode_block(data: bytes, process: str, n: int, r: int, c: int = 8) -> list[list[int]]:
    """n pixels of r frames each."""
    b = BitReader(data)
    if process == "mono":
        b.number(7)
        return [[b.number(c)] * r] * n
    if process == "pp":
        b.number(6)
        form = b.number(2) + 1
        return [read_pixel(b, r, form, c) for _ in range(n)]
    if process == "spatial":
        b.number(8)
        top = b.raw(r)
        b.gamma()
        at = [k for k, x in enumerate(top) if x == "1"]
        return [spread([(k, b.number(c)) for k in at], r) if b.raw(1) == "1" else read_pixel(b, r, 4, c) for _ in range(n)]
    b.number(7)
    pairs = []
    count = b.gamma()
    b.raw(1)
    for _ in range(count):
        a = b.number(c)
        pairs.append((a, b.number(c)))
    width = max(1, (len(pairs) - 1).bit_length())
    out = []
    for _ in range(n):
        seq = [b.number(c)]
        for _ in range(r - 1):
            seq.append(pairs[b.number(width)][1] if b.raw(1) == "1" else seq[-1])
        out.append(seq)
    return out


def encode_indexed(pixels: list[list[int]], c: int = 8) -> tuple[bytes, int]:
    """Payload and bits of pixels by a palette: each pixel's number of steps, their combination, and palette places of its colours."""
    w = BitWriter()
    colors = sorted({v for seq in pixels for v in seq})
    write_palette(w, colors, c)
    width, at = max(1, (len(colors) - 1).bit_length()), {v: i for i, v in enumerate(colors)}
    for seq in pixels:
        k = steps(seq)
        w.gamma(len(k)).number(colex(k), (comb(len(seq), len(k)) - 1).bit_length())
        for i in k:
            w.number(at[seq[i]], width)
    return w.bytes(), w.size


def decode_indexed(data: bytes, n: int, r: int, c: int = 8) -> list[list[int]]:
    b = BitReader(data)
    colors = read_palette(b, c)
    width, out = max(1, (len(colors) - 1).bit_length()), []
    for _ in range(n):
        k = b.gamma()
        at = colex_unrank(b.number((comb(r, k) - 1).bit_length()), k, r)
        out.append(spread([(i, colors[b.number(width)]) for i in at], r))
    return out


def indexed_blocks(cells: DataFrame, keys: tuple[str, ...] = ("block", "gop")) -> DataFrame:
    """(keys, bits, same) of cells (keys, x, f, c) written by a palette and read again."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "f"])
        pixels = [s.astype(int).tolist() for _, s in pdf.groupby("x", sort=True)["c"]]
        data, bits = encode_indexed(pixels)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), bits, decode_indexed(data, len(pixels), len(pixels[0])) == pixels)], columns=[*keys, "bits", "same"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.select(*keys, "x", "f", "c").groupBy(*keys).applyInPandas(one, f"{kinds}, bits long, same boolean")


def block_payloads(cells: DataFrame, lengths: DataFrame, keys: tuple[str, ...] = ("block", "gop")) -> DataFrame:
    """(keys, n, r, process, bits, payload) of cells (keys, x, f, c) by the process that lengths (keys, process) names."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "f"])
        pixels = [s.astype(int).tolist() for _, s in pdf.groupby("x", sort=True)["c"]]
        process = pdf["process"].iloc[0]
        data, bits = encode_block(pixels, process)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), len(pixels), len(pixels[0]), process, bits, data)], columns=[*keys, "n", "r", "process", "bits", "payload"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    both = cells.select(*keys, "x", "f", "c").join(lengths.select(*keys, "process"), list(keys))
    return both.groupBy(*keys).applyInPandas(one, f"{kinds}, n int, r int, process string, bits long, payload binary")


def block_cells(payloads: DataFrame, keys: tuple[str, ...] = ("block", "gop")) -> DataFrame:
    """(keys, x: which pixel, k: which frame, c) of payloads."""

    def run(batches):
        for pdf in batches:
            rows = [(*key, x, k, v) for *key, n, r, process, data in pdf[[*keys, "n", "r", "process", "payload"]].itertuples(index=False) for x, seq in enumerate(decode_block(bytes(data), process, n, r)) for k, v in enumerate(seq)]
            yield pd.DataFrame(rows, columns=[*keys, "x", "k", "c"])

    kinds = ", ".join(f"{k} {payloads.schema[k].dataType.simpleString()}" for k in keys)
    return payloads.mapInPandas(run, f"{kinds}, x int, k int, c int")


def group_of_pictures(cells: DataFrame, gop: int, block: str = "block") -> DataFrame:
    """cells with gop and f (frames of a block numbered from 0)."""
    from pyspark.sql.window import Window as W

    frames = cells.select(block, "t").distinct().withColumn("f", F.row_number().over(W.partitionBy(block).orderBy("t")) - 1)
    return cells.join(frames, [block, "t"]).withColumn("gop", F.floor(F.col("f") / gop).cast("int"))
