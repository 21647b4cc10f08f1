"""Z-order values: bits of two or more numbers interleaved, the first number's bit the lower one of each pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks that spread 32 bits over 64, and the shifts before them.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread(x: Column) -> Column:
    """The bits of a number under 2^32 on the even places of 64."""
    x = x.cast("long")
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def gather(z: Column) -> Column:
    """The inverse of spread, from the even places."""
    z = z.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    for (shift, _), (_, mask) in zip(_SPREAD[::-1], [*_SPREAD[-2::-1], (0, 0xFFFFFFFF)], strict=True):
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return z


def interleave(x: Column, y: Column) -> Column:
    """Two numbers of 16 bits in 32, or of 32 in 64 (a negative long where y's top bit is set; see sortable)."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def decode(z: Column) -> tuple[Column, Column]:
    return gather(z), gather(F.shiftrightunsigned(z, 1))


def sortable(z: Column) -> Column:
    """A long whose signed order is the unsigned order of z."""
    return z.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def flow_z(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column) -> Column:
    """96 bits of a 4-tuple as a struct of three longs, comparable field by field: addresses' high halves first."""
    hi = interleave(F.shiftright(src_ip, 16), F.shiftright(dst_ip, 16))
    mid = interleave(src_ip.bitwiseAND(0xFFFF), dst_ip.bitwiseAND(0xFFFF))
    return F.struct(hi.alias("high"), mid.alias("mid"), interleave(src_port, dst_port).alias("low"))


def prefix(z: Column, level: int, bits: int = 32) -> Column:
    """The leading 4-bit digits of z down to a level."""
    return F.shiftrightunsigned(z, bits - 4 * level)


def suffix(z: Column, level: int, bits: int = 32) -> Column:
    """What is left of z below a level."""
    return z.bitwiseAND(F.lit((1 << (bits - 4 * level)) - 1).cast("long"))


def split_box(x0: int, y0: int, x1: int, y1: int, bits: int = 16, most: int = 32) -> list[tuple[int, int]]:
    """At most `most` ranges of z, both ends included, that together cover a box: scans prune by them, an exact filter follows."""
    ranges, todo = [], [(0, 0, bits)]
    while todo:
        x, y, size = todo.pop(0)
        side = 1 << size
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            continue
        inside = x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1
        if inside or size == 0 or len(ranges) + len(todo) + 4 > most:
            z = sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))
            ranges.append((z, z + side * side - 1))
        else:
            half = side >> 1
            todo += [(x, y, size - 1), (x + half, y, size - 1), (x, y + half, size - 1), (x + half, y + half, size - 1)]
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged
