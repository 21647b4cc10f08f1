"""Packet bytes to columns, as expressions that stay inside the JVM."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP = 6, 17


def uint(data: Column, at: Column | int, size: int) -> Column:
    """A big-endian unsigned number of 1 to 7 bytes at a byte offset; null where the data end before it."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long"))


def version(packet: Column) -> Column:
    """4, 6 or 0 for what is neither."""
    v = F.shiftright(uint(packet, 0, 1), 4)
    return F.when(v.isin(4, 6), v).otherwise(0).cast("int")


def header_length(packet: Column) -> Column:
    """Bytes before the transport header: IHL * 4, or 40 for version 6, whose extensions aren't walked."""
    v = version(packet)
    return F.when(v == 4, uint(packet, 0, 1).bitwiseAND(15) * 4).when(v == 6, F.lit(40).cast("long"))


def protocol(packet: Column) -> Column:
    v = version(packet)
    return F.when(v == 4, uint(packet, 9, 1)).when(v == 6, uint(packet, 6, 1)).cast("int")


def _port(packet: Column, k: int) -> Column:
    """Ports are those of TCP and UDP; other protocols have 0."""
    known = protocol(packet).isin(TCP, UDP)
    return F.when(version(packet) != 0, F.when(known, F.coalesce(uint(packet, header_length(packet) + k, 2), F.lit(0))).otherwise(0)).cast("int")


def packet_columns(packet: Column) -> dict[str, Column]:
    """All decoded columns of a layer-3 packet; addresses are null for the other version and for what isn't IP."""
    v = version(packet)
    ip6 = lambda at: F.when((v == 6) & (F.octet_length(packet) >= at + 16), F.substring(packet, at + 1, 16))
    flags = uint(packet, header_length(packet) + 13, 1)
    return {
        "version": v,
        "src_ip": F.when(v == 4, uint(packet, 12, 4)),
        "dst_ip": F.when(v == 4, uint(packet, 16, 4)),
        "src_ip6": ip6(8),
        "dst_ip6": ip6(24),
        "protocol": protocol(packet),
        "src_port": _port(packet, 0),
        "dst_port": _port(packet, 2),
        "tcp_flags": F.when(protocol(packet) == TCP, flags).cast("int"),
    }


def field(packet: Column, bit_offset: int, bit_length: int) -> Column:
    """A tag field: length 0 gives the offset itself as a literal, 8 and 16 the bytes there; other lengths 0."""
    if bit_length == 0:
        return F.lit(bit_offset).cast("long")
    if bit_length in (8, 16):
        return F.coalesce(uint(packet, bit_offset // 8, bit_length // 8), F.lit(0).cast("long"))
    return F.lit(0).cast("long")


def pointer(port_id: Column, rx_id: Column, off: Column) -> Column:
    """A packet's address in one number: 8 bits of port, 8 of queue, 48 of offset. Decimal, since port 128 and above pass 2^63."""
    d = lambda c: c.cast("decimal(20,0)")
    return (d(port_id) * F.lit(1 << 56).cast("decimal(20,0)") + d(rx_id) * F.lit(1 << 48).cast("decimal(20,0)") + d(off)).cast("decimal(20,0)")


def ip_to_long(text: Column) -> Column:
    """Dotted quad to number; null for anything else."""
    parts = F.transform(F.split(text, "\\."), lambda x: x.try_cast("long"))
    good = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def long_to_ip(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def ip6_to_binary(text: Column) -> Column:
    """Version 6 text, with or without ::, to its 16 bytes; null where it is none. Embedded dotted quads aren't read."""
    halves = F.split(F.lower(text), "::")
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
    left, right = groups(F.get(halves, F.lit(0))), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    all_ = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    good = (F.size(halves) <= 2) & F.forall(all_, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (F.size(all_) == 8) & ((F.size(halves) == 2) | (missing == 0))
    return F.when(good, F.unhex(F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), "")))


def cidr(text: str) -> tuple[int, int, int]:
    """(version, first, last) of a network, both ends included; host bits are dropped."""
    net = ipaddress.ip_network(text, strict=False)
    return net.version, int(net.network_address), int(net.broadcast_address)


def epoch_us(seconds: str | float | int) -> int:
    """Microseconds of "sec.frac"."""
    whole, _, frac = str(seconds).partition(".")
    return int(whole) * 1_000_000 + int((frac + "000000")[:6])
