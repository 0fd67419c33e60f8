"""Histogram bins of fixed relative width, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickspark.functions.timeunits import whole

#: Bits of a bin's number at each resolution from 0 to 5.
BITS = (0, 5, 9, 13, 17, 21)


def bit_length(x: Column) -> Column:
    """Binary digits of a non-negative integer, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def leading_bits(coefficient: Column, bits: int) -> Column:
    """The top ``bits`` bits of an integer shifted left until its first bit leads: bins for prices and quantities."""
    if not bits:
        return F.lit(0).cast("long")
    n = bit_length(coefficient)
    return F.when(coefficient == 0, F.lit(0).cast("long")).otherwise(F.when(n >= bits, F.call_function("shiftright", coefficient, n - bits)).otherwise(F.call_function("shiftleft", coefficient, bits - n)).cast("long"))


def price_bin(coefficient: Column, bits: int) -> Column:
    return leading_bits(coefficient, bits)


def octave_bin(units: Column, bits: int, per_unit: int) -> Column:
    """Octaves of whole units (plus one), each cut evenly into 2 ** (bits - 5): bins for times and positive samples.

    ``units`` counts parts of which ``per_unit`` make one unit.
    """
    if not bits:
        return F.lit(0).cast("long")
    octave = bit_length(whole(units, per_unit) + 1) - 1
    start = (F.call_function("shiftleft", F.lit(1).cast("long"), octave) - 1) * per_unit
    width = F.call_function("shiftleft", F.lit(1).cast("long"), octave) * per_unit
    parts = 1 << max(0, bits - 5)
    return octave.cast("long") * parts + F.least(whole((units - start) * parts, width), F.lit(parts - 1).cast("long"))


def octave_edges(bits: int, octaves: int = 32) -> list[tuple[int, float, float]]:
    """(bin, lo, hi) of ``octave_bin`` in units, for histograms that list empty bins too."""
    parts = 1 << max(0, bits - 5)
    return [(o * parts + p, (1 << o) - 1 + (1 << o) * p / parts, (1 << o) - 1 + (1 << o) * (p + 1) / parts) for o in range(octaves) for p in range(parts)]


def relative_bin(parts: Column, bits: int) -> Column:
    """Bins of a value in units of 1e-5, negative ones in bin 0: the value itself below a pivot of a power of ten, then its
    leading part above each further power of the pivot."""
    if not bits:
        return F.lit(0).cast("long")
    pivot, last = 10 ** (bits >> 2), F.lit((1 << bits) - 1).cast("long")
    out, level = F.when(parts < 0, F.lit(0).cast("long")), 0
    while pivot**level < 10**18:
        top = pivot ** (level + 1)
        value = whole(parts, pivot**level) + level * (pivot - 1)
        out = out.when(parts < top, value) if top < 10**18 else out.otherwise(value)
        level += 1
    return F.least(out, last)


def signed_bin(parts: Column, bits: int) -> Column:
    """``relative_bin`` of the absolute value, mirrored around the middle and at half the resolution."""
    if not bits:
        return F.lit(0).cast("long")
    slot = relative_bin(F.abs(parts), bits)
    return whole(F.when(parts < 0, -slot - 1).otherwise(slot) + (1 << bits), 2)


def quantity_bin(coefficient: Column, bits: int) -> Column:
    """As ``price_bin``, of the upper 32 bits where there are any."""
    upper = F.call_function("shiftright", coefficient, F.lit(32))
    return leading_bits(F.when(upper != 0, upper).otherwise(coefficient), bits)
