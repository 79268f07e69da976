"""Scalar column functions: bits, intervals, boxes, lattices, periodic wrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def long(c: Column) -> Column:
    return c.cast("long")


# Bits ------------------------------------------------------------------------------------------


def count_ones(x: Column) -> Column:
    return F.bit_count(x)


def leading_zeros(x: Column, width: int) -> Column:
    return F.when(x == 0, width).otherwise(width - F.length(F.bin(long(x))))


def trailing_zeros(x: Column, width: int) -> Column:
    return F.when(x == 0, width).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def bit(x: Column, k: Column | int) -> Column:
    """Bit k of x."""
    return F.getbit(long(x), F.lit(k) if isinstance(k, int) else k).cast("int")


def bit_for_axis(mask: Column, axis: Column) -> Column:
    """Set bits of the mask below a 0-based axis."""
    return F.bit_count(long(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), axis) - 1))


def positions(mask: Column, width: int) -> Column:
    """0-based places of set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(long(mask), i) == 1)


def nth_set_bit(mask: Column, n: Column, width: int) -> Column:
    """0-based place of the n-th set bit (from 0); ``width`` if there is none."""
    return F.coalesce(F.get(positions(mask, width), n), F.lit(width))


def pdep(src: Column, mask: Column, width: int) -> Column:
    """The low bits of ``src`` scattered to the set bits of ``mask``."""

    def put(acc: Column, i: Column) -> Column:
        k = F.bit_count(long(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1))
        on = (F.getbit(long(mask), i) == 1) & (F.getbit(long(src), k) == 1)
        return acc.bitwiseOR(F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), put)


def pext(src: Column, mask: Column, width: int) -> Column:
    """The bits of ``src`` under the set bits of ``mask``, gathered at the low end."""

    def put(acc: Column, i: Column) -> Column:
        k = F.bit_count(long(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1))
        on = (F.getbit(long(mask), i) == 1) & (F.getbit(long(src), i) == 1)
        return acc.bitwiseOR(F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), put)


def children_count(mask: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.bit_count(mask))


def isotropic_mask(dim: int) -> int:
    return (1 << dim) - 1


def set_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseOR(flag)


def clear_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(~flag)


def mask_type(dim: int) -> str:
    """Spark type that holds a mask of ``dim`` axes."""
    return "int" if dim <= 30 else "bigint"


def volume_denominator_type(dim: int, levels: int) -> str:
    """Spark type that holds 2 ** (dim * levels) exactly."""
    return "bigint" if dim * levels <= 62 else "decimal(38,0)"


# Intervals and boxes ---------------------------------------------------------------------------


def interval_empty(lo: Column, hi: Column) -> Column:
    """Not hi > lo, or a NaN. Spark sorts NaN above all numbers, so it is asked for first."""
    return F.isnan(lo) | F.isnan(hi) | ~(hi > lo)


def interval_length(lo: Column, hi: Column) -> Column:
    return F.when(interval_empty(lo, hi), 0.0).otherwise(hi - lo)


def interval_intersection(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Struct (lo, hi); both NaN where nothing of positive length is shared."""
    lo, hi = F.greatest(alo, blo), F.least(ahi, bhi)
    void = interval_empty(alo, ahi) | interval_empty(blo, bhi) | ~(hi > lo)
    return F.struct(F.when(void, nan()).otherwise(lo).alias("lo"), F.when(void, nan()).otherwise(hi).alias("hi"))


def interval_contains(lo: Column, hi: Column, x: Column) -> Column:
    """Closed; false for NaN."""
    return ~(F.isnan(lo) | F.isnan(hi) | F.isnan(x)) & (x >= lo) & (x <= hi)


def to_reference(lo: Column, hi: Column, x: Column) -> Column:
    """(x - lo) / (hi - lo); an error on an empty interval."""
    return F.when(interval_empty(lo, hi), F.raise_error(F.lit("the interval is empty")).cast("double")).otherwise((x - lo) / (hi - lo))


def from_reference(lo: Column, hi: Column, t: Column) -> Column:
    return F.when(interval_empty(lo, hi), F.raise_error(F.lit("the interval is empty")).cast("double")).otherwise(lo + t * (hi - lo))


def boxes_overlap(alo: list[Column], ahi: list[Column], blo: list[Column], bhi: list[Column]) -> Column:
    """Strict on every axis: boxes that touch do not overlap."""
    return reduce(lambda x, y: x & y, [(a > b) & (c > d) for a, b, c, d in zip(ahi, blo, bhi, alo, strict=True)])


def in_box(p: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Closed box."""
    return reduce(lambda x, y: x & y, [(x >= a) & (x <= b) for x, a, b in zip(p, lo, hi, strict=True)])


def product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def wrap(x: Column, length: Column | float) -> Column:
    """Periodic wrap into [0, length)."""
    n = F.lit(float(length)) if isinstance(length, int | float) else length
    return x - n * F.floor(x / n)


def cell_of_position(p: list[Column], n: int, length: float, open_below: bool = False) -> Column:
    """1-based cell of a position in a grid of n cells per axis, first axis fastest.

    Positions beyond the grid count to its outermost cells. With ``open_below`` this holds for the upper
    side only: below zero an axis counts on downwards.
    """
    at = [F.floor(x * n / length) if open_below else F.greatest(F.floor(x * n / length), F.lit(0)) for x in p]
    at = [F.least(i, F.lit(n - 1)) for i in at]
    return total([i * n**k for k, i in enumerate(at)]) + 1


# Integer lattices ------------------------------------------------------------------------------


class Lattice:
    """An equal-scale integer lattice over a box: (2 ** bits - 1) steps along the longest axis."""

    def __init__(self, lo: list[float], hi: list[float], bits: int = 16, int_bits: int = 32) -> None:
        if bits >= int_bits:
            raise ValueError(f"2^{bits} - 1 does not fit {int_bits} bits")
        if any(not h > a for a, h in zip(lo, hi, strict=True)):
            raise ValueError("hi must exceed lo on every axis")
        self.lo, self.hi, self.int_max = lo, hi, (1 << (int_bits - 1)) - 1
        self.scale = ((1 << bits) - 1) / max(h - a for a, h in zip(lo, hi, strict=True))

    def quantize(self, x: Column, axis: int) -> Column:
        """Nearest lattice number, halves to even, held within the integer type."""
        v = F.rint((x - self.lo[axis]) * self.scale)
        return long(F.least(F.greatest(v, F.lit(float(-self.int_max - 1))), F.lit(float(self.int_max))))

    def quantize_strict(self, x: Column, axis: int, atol: float) -> Column:
        q = self.quantize(x, axis)
        return F.when(F.abs(self.dequantize(q, axis) - x) > atol, F.raise_error(F.lit("the point is off the lattice")).cast("long")).otherwise(q)

    def dequantize(self, q: Column, axis: int) -> Column:
        return self.lo[axis] + q / F.lit(self.scale)

    def unscale_volume(self, v: Column) -> Column:
        return v / F.lit(self.scale ** len(self.lo))

    def unscale_moment(self, m: Column, degree: int) -> Column:
        return m / F.lit(self.scale ** (len(self.lo) + degree))
