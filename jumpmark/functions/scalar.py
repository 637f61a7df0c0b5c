"""Scalar expressions: logarithms of counts, universal code lengths, bit packing, colour conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_safe(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(0.0))


def log2_comb(n: Column, k: Column) -> Column:
    """log2 of n over k; 0 outside 0 < k < n. Sums min(k, n - k) terms."""
    kk = F.least(k, n - k)
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(kk, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log2((n - kk + i).cast("double")) - F.log2(i.cast("double")))
    return F.when((k > 0) & (k < n), terms).otherwise(F.lit(0.0))


def floor_log2(n: Column) -> Column:
    """For n >= 1, exactly, by the length of the binary form."""
    return F.length(F.bin(n.cast("long"))) - 1


def gamma_bits(n: Column) -> Column:
    return F.when(n >= 1, 2 * floor_log2(n) + 1).otherwise(0)


def delta_bits(n: Column) -> Column:
    k = floor_log2(n)
    return F.when(n >= 1, 1 + k + 2 * floor_log2(1 + k)).otherwise(0)


def gamma_code(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), floor_log2(n)), F.bin(n.cast("long")))


def dictionary_bits(m: Column) -> Column:
    """Bits of a Huffman dictionary of m symbols."""
    return F.when(m > 1, m * (floor_log2(m) + 1)).otherwise(0)


def trailing_zeros(x: Column) -> Column:
    """64 for 0."""
    x = x.cast("long")
    return F.when(x == 0, 64).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


#: Fields of the method code: name, shift, width (bits), smallest and largest value.
CARTOUCHE = [("A", 14, 3, 0, 4), ("B", 12, 2, 0, 3), ("C", 9, 3, 0, 4), ("D", 7, 2, 0, 2), ("E", 5, 2, 0, 3), ("F", 3, 2, 1, 3), ("G", 1, 2, 0, 3), ("H", 0, 1, 0, 1)]


def pack_cartouche(fields: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, shift, *_ in CARTOUCHE:
        out = out.bitwiseOR(F.shiftleft(fields[name].cast("int"), shift))
    return out


def unpack_cartouche(code: Column) -> dict[str, Column]:
    return {name: F.shiftright(code.cast("int"), shift).bitwiseAND(F.lit((1 << width) - 1)) for name, shift, width, *_ in CARTOUCHE}


def valid_cartouche(fields: dict[str, Column]) -> Column:
    ok = F.lit(True)
    for name, _, _, low, high in CARTOUCHE:
        ok = ok & fields[name].between(low, high)
    return ok


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer BT.601 with shifts, clipped to a byte."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255))
    y = F.shiftright(66 * r + 129 * g + 25 * b + 128, 8) + 16
    cb = F.shiftright(-38 * r - 74 * g + 112 * b + 128, 8) + 128
    cr = F.shiftright(112 * r - 94 * g - 18 * b + 128, 8) + 128
    return clip(y), clip(cb), clip(cr)


def clean(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)

#: Fields of the 7-bit method code of the block coder: name, shift, width.
METHOD = [("proc", 5, 2), ("rep", 3, 2), ("comp", 1, 2), ("col", 0, 1)]


def pack_method(fields: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, shift, width in METHOD:
        out = out.bitwiseOR(F.shiftleft(fields[name].cast("int").bitwiseAND(F.lit((1 << width) - 1)), shift))
    return out


def unpack_method(code: Column) -> dict[str, Column]:
    return {name: F.shiftright(code.cast("int"), shift).bitwiseAND(F.lit((1 << width) - 1)) for name, shift, width in METHOD}


def fragment(uri: Column, name: str) -> Column:
    """A parameter of a URI's fragment; null if it is not there."""
    found = F.regexp_extract(uri, rf"#(?:.*&)?{name}=([^&]*)", 1)
    return F.when(found != "", found)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two vectors of columns."""
    return F.sqrt(sum(((x - y).cast("double") * (x - y).cast("double") for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def log_comb(n: Column, k: Column) -> Column:
    """Natural logarithm of n over k; minus infinity outside 0 <= k <= n."""
    import math

    return F.when((k < 0) | (k > n), F.lit(float("-inf"))).otherwise(log2_comb(n, k) * math.log(2.0))


def comb(n: Column, k: Column) -> Column:
    """n over k exactly, for n up to 60; 0 outside 0 <= k <= n."""
    kk = F.least(k, n - k).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(kk, F.lit(1)))
    value = F.aggregate(steps, F.lit(1).cast("long"), lambda a, i: F.call_function("div", a * (n - kk + i).cast("long"), i.cast("long")))
    return F.when((k < 0) | (k > n), 0).when(kk == 0, 1).otherwise(value).cast("long")


def bits_to_int(bits: Column) -> Column:
    """The number an array of 0 and 1 spells, most significant first."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))


def int_to_bits(value: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", value.cast("long"), i).bitwiseAND(F.lit(1)).cast("int"))


def log_star_bits(n: Column, rounds: int = 6) -> Column:
    """1 plus the rounded up iterated binary logarithms that stay above 0, the first `rounds` of them; 0 below 1. Six rounds do for any 64-bit number.

    The first is rounded up by the length of a binary form: Spark's log2 of some powers of two (2^29) is a little too large.
    """
    x, more = n.cast("double"), lambda x: F.when(x > 1, F.log2(x)).otherwise(0.0)
    first = F.struct(more(x).alias("x"), F.when(n > 1, floor_log2(n - 1) + 2).otherwise(1).cast("long").alias("s"))
    done = F.aggregate(F.array_repeat(F.lit(0), rounds - 1), first, lambda a, _: F.struct(more(a["x"]).alias("x"), (a["s"] + F.ceil(more(a["x"]))).alias("s")))
    return F.when(n < 1, 0).otherwise(done["s"])


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Whole numbers, by shifts, clipped to a byte."""
    c, d, e = y - 16, cb - 128, cr - 128
    byte = lambda v: F.least(F.greatest(F.shiftright(v.cast("int"), 8), F.lit(0)), F.lit(255))
    return byte(298 * c + 409 * e + 128), byte(298 * c - 100 * d - 208 * e + 128), byte(298 * c + 516 * d + 128)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def basis(family: str, k: int, dimension: int, t: Column, span: float) -> Column:
    """The k-th basis function of a family at t in [0, span): right-open bins, powers, or 1, cos, sin, ... (others: bins)."""
    import math

    if family == "polynomial":
        return F.pow(t / span, F.lit(k)) if k else F.lit(1.0)
    if family == "trigonometric":
        turn = 2 * math.pi * ((k + 1) // 2) / span * t
        return F.lit(1.0) if k == 0 else F.cos(turn) if k % 2 else F.sin(turn)
    edge = span / dimension
    return ((t >= k * edge) & (t < (k + 1) * edge)).cast("double")


#: Intensity and its integral of each family, as expressions of time and parameters.
INTENSITIES = {
    "homogeneous": (lambda t, lambda0=0.1: F.lit(lambda0) + 0 * t, lambda t, lambda0=0.1: lambda0 * t),
    "linear": (lambda t, a=0.01, b=0.01: a * t + b, lambda t, a=0.01, b=0.01: 0.5 * a * t * t + b * t),
    "sinusoidal": (lambda t, lambda0=0.1, amplitude=0.5, omega=0.19634954084936207, phi=0.0: F.greatest(lambda0 * (1 + amplitude * F.sin(omega * t + phi)), F.lit(1e-10)), lambda t, lambda0=0.1, amplitude=0.5, omega=0.19634954084936207, phi=0.0: lambda0 * (t - amplitude / omega * F.cos(omega * t + phi))),
    "exponential": (lambda t, lambda0=0.1, beta=0.01: lambda0 * F.exp(beta * t), lambda t, lambda0=0.1, beta=0.01: lambda0 / beta * (F.exp(beta * t) - 1)),
    "logarithmic": (lambda t, lambda0=0.1, gamma=0.1: lambda0 * F.log(1 + gamma * t + 1e-10), lambda t, lambda0=0.1, gamma=0.1: lambda0 / gamma * ((1 + gamma * t) * F.log(1 + gamma * t + 1e-10) - gamma * t)),
    "power": (lambda t, lambda0=0.1, p=1.0: lambda0 * F.pow(F.greatest(t, F.lit(1e-10)), F.lit(p)), lambda t, lambda0=0.1, p=1.0: lambda0 / (p + 1) * F.pow(F.greatest(t, F.lit(1e-10)), F.lit(p + 1))),
}
