"""Bit strings: writing and reading, universal codes of integers, Huffman codes with their dictionary, palettes."""

from __future__ import annotations

from jumpmark.functions.coding import canonical, code_lengths


class BitWriter:
    """Pieces of '0' and '1', most significant first; bytes() pads the last byte with zeros."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0

    def raw(self, bits: str) -> BitWriter:
        self.pieces.append(bits)
        self.size += len(bits)
        return self

    def number(self, value: int, width: int) -> BitWriter:
        return self.raw(format(value, f"0{width}b") if width else "")

    def gamma(self, n: int) -> BitWriter:
        """n >= 1."""
        b = format(n, "b")
        return self.raw("0" * (len(b) - 1) + b)

    def delta(self, n: int) -> BitWriter:
        b = format(n, "b")
        return self.gamma(len(b)).raw(b[1:])

    def bits(self) -> str:
        return "".join(self.pieces)

    def bytes(self) -> bytes:
        b = self.bits()
        b += "0" * (-len(b) % 8)
        return int(b, 2).to_bytes(len(b) // 8, "big") if b else b""


class BitReader:
    """Reads what BitWriter writes; EOFError behind the end."""

    def __init__(self, data: bytes) -> None:
        self.text = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else ""
        self.at = 0

    def raw(self, width: int) -> str:
        if self.at + width > len(self.text):
            raise EOFError("bits end early")
        self.at += width
        return self.text[self.at - width : self.at]

    def number(self, width: int) -> int:
        return int(self.raw(width), 2) if width else 0

    def gamma(self) -> int:
        one = self.text.find("1", self.at)
        if one < 0:
            raise EOFError("bits end early")
        zeros = one - self.at
        self.at = one
        return self.number(zeros + 1)

    def delta(self) -> int:
        n = self.gamma()
        return int("1" + self.raw(n - 1), 2)


def write_huffman(w: BitWriter, symbols: list[int]) -> dict[int, str]:
    """The dictionary of symbols' canonical code: their number (16 bits), then each symbol and its code's length (8 bits each)."""
    freqs: dict[int, int] = {}
    for s in symbols:
        freqs[s] = freqs.get(s, 0) + 1
    codes = canonical(code_lengths(freqs)) if freqs else {}
    w.number(len(codes), 16)
    for s, c in sorted(codes.items()):
        w.number(s, 8).number(len(c), 8)
    return codes


def read_huffman(r: BitReader) -> dict[str, int]:
    """Code to symbol."""
    lengths = {}
    for _ in range(r.number(16)):
        s = r.number(8)
        lengths[s] = r.number(8)
    return {c: s for s, c in canonical(lengths).items()}


def read_symbol(r: BitReader, codes: dict[str, int]) -> int:
    at = ""
    while at not in codes:
        at += r.raw(1)
    return codes[at]


def huffman_pays(symbols: list[int], width: int = 8) -> bool:
    """Whether a Huffman code with its dictionary takes fewer bits than symbols of a fixed width."""
    n = len(set(symbols))
    if not n:
        return False
    freqs = {s: symbols.count(s) for s in set(symbols)}
    lengths = code_lengths(freqs)
    average = sum(freqs[s] * lengths[s] for s in freqs) / len(symbols)
    overhead = n * (width + 5) + 2 * (n.bit_length() - 1) + 1
    return overhead + int(average * len(symbols)) < width * len(symbols)


def write_palette(w: BitWriter, colors: list[int], width: int = 8) -> None:
    """The number of colours as a gamma code, then the colours."""
    w.gamma(len(colors))
    for c in colors:
        w.number(c, width)


def read_palette(r: BitReader, width: int = 8) -> list[int]:
    return [r.number(width) for _ in range(r.gamma())]
