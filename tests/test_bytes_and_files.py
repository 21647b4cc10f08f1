"""Decoders, addresses, z-order, vectors, text flows and capture files."""

import ipaddress
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import decode, zorder
from flowloom.operators import index
from flowloom.sources import packets, pcap

V4 = bytes.fromhex("450000280000000040060000c0a80001c0a80002") + bytes.fromhex("01bb04d2000000000000000050120000000000")
V4_OPTIONS = bytes.fromhex("46000020000000004011000001020304ff000001") + b"\0" * 4 + bytes.fromhex("0035ffff00080000")
ICMP = bytes.fromhex("4500001c000000004001000001020304050607080800")
V6 = bytes.fromhex("600000000008113f") + ipaddress.IPv6Address("2001:db8::1").packed + ipaddress.IPv6Address("ff02::2").packed + bytes.fromhex("00500051")


def test_packets_of_all_kinds(spark):
    rows = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in enumerate([V4, V4_OPTIONS, ICMP, V6, b"", b"\x45", b"\x99abc", None, V4[:21]])], "i int, p binary")
    got = {r["i"]: r for r in rows.select("i", *(c.alias(n) for n, c in decode.packet_columns(F.col("p")).items())).collect()}
    assert (got[0]["src_ip"], got[0]["dst_ip"], got[0]["src_port"], got[0]["dst_port"], got[0]["tcp_flags"], got[0]["protocol"]) == (0xC0A80001, 0xC0A80002, 443, 1234, 0x12, 6)
    assert (got[1]["src_port"], got[1]["dst_port"], got[1]["dst_ip"], got[1]["tcp_flags"]) == (53, 65535, 0xFF000001, None)
    assert (got[2]["src_port"], got[2]["dst_port"], got[2]["protocol"]) == (0, 0, 1)
    assert bytes(got[3]["src_ip6"]) == ipaddress.IPv6Address("2001:db8::1").packed and (got[3]["src_ip"], got[3]["src_port"], got[3]["dst_port"]) == (None, 80, 81)
    for i in (4, 6):
        assert (got[i]["version"], got[i]["src_ip"], got[i]["src_port"]) == (0, None, None)
    assert got[5]["version"] == 4 and got[5]["src_ip"] is None and got[8]["src_port"] == 0 and got[7]["version"] == 0


def test_tag_fields(spark):
    p = spark.createDataFrame([(bytearray(range(40)),)], "p binary")
    got = p.select(*(decode.field(F.col("p"), o, n).alias(f"f{k}") for k, (o, n) in enumerate([(300, 0), (16, 8), (16, 16), (264, 16), (16, 32), (800, 8)]))).first()
    assert list(got) == [300, 2, 0x0203, 0x2122, 0, 0]


def test_pointers_pass_63_bits(spark):
    got = spark.range(1).select(decode.pointer(F.lit(200), F.lit(3), F.lit(123456789012)).cast("string")).first()[0]
    assert int(got) == 200 << 56 | 3 << 48 | 123456789012


@pytest.mark.parametrize("text", ["::", "::1", "2001:db8::", "1:2:3:4:5:6:7:8", "fe80::1:2", "1::8", "1:2:3:4:5:6:7::", "nonsense", "1::2::3", "12345::", "1:2:3", ""])
def test_addresses(spark, text):
    try:
        want = ipaddress.IPv6Address(text).packed
    except ValueError:
        want = None
    got = spark.createDataFrame([(text,)], "t string").select(decode.ip6_to_binary(F.col("t"))).first()[0]
    assert (bytes(got) if got is not None else None) == want


def test_dotted_quads(spark):
    rows = spark.createDataFrame([("10.0.0.1",), ("255.255.255.255",), ("1.2.3",), ("256.1.1.1",), ("a",), (None,)], "t string")
    assert [r[0] for r in rows.select(decode.ip_to_long(F.col("t"))).collect()] == [167772161, 4294967295, None, None, None, None]
    assert rows.limit(1).select(decode.long_to_ip(decode.ip_to_long(F.col("t")))).first()[0] == "10.0.0.1"


def test_zorder_of_32_bits(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 32, (50, 2))] + [(0, 0), ((1 << 32) - 1, (1 << 32) - 1)]
    rows = spark.createDataFrame(pairs, "x long, y long").withColumn("z", zorder.interleave(F.col("x"), F.col("y")))
    a, b = zorder.decode(F.col("z"))
    for r in rows.withColumns({"a": a, "b": b, "o": zorder.sortable(F.col("z"))}).collect():
        want = sum((r["x"] >> k & 1) << 2 * k | (r["y"] >> k & 1) << 2 * k + 1 for k in range(32))
        assert r["z"] % (1 << 64) == want and (r["a"], r["b"]) == (r["x"], r["y"]) and r["o"] == want - (1 << 63)
    low = rows.select(zorder.prefix(F.lit(0xABCD1234), 3).alias("p"), zorder.suffix(F.lit(0xABCD1234), 3).alias("s")).first()
    assert (low["p"], low["s"]) == (0xABC, 0xD1234)


def test_boxes_cover(spark):
    for box in ((3, 5, 17, 9), (0, 0, 65535, 65535), (7, 7, 7, 7), (100, 0, 101, 65535)):
        ranges = zorder.split_box(*box)
        assert all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        for x in (box[0], box[2]):
            for y in (box[1], box[3]):
                z = sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(16))
                assert any(a <= z <= b for a, b in ranges)


def test_clustered_files_give_the_box(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 61).cast("int").alias("x"), (F.col("id") % 97).cast("int").alias("y"), "id")
    index.write_clustered(rows, f"{tmp_path}/z", "x", "y", 3)
    back = spark.read.parquet(f"{tmp_path}/z")
    got = index.box(back, "x", "y", 5, 10, 20, 40, "z")
    assert got.count() == rows.where("x between 5 and 20 and y between 10 and 40").count() and "PushedFilters: [" in got._jdf.queryExecution().toString()


def test_binary_vectors(spark, tmp_path):
    v4 = np.array([(1, 2**32 - 1, 80, 65535), (7, 8, 9, 10)], packets.VECTORS["flow4"])
    (tmp_path / "a.vec").write_bytes(v4.tobytes())
    assert [tuple(r)[1:] for r in packets.binary_vector(spark, str(tmp_path / "a.vec"), "flow4").collect()] == [(0, 1, 2**32 - 1, 80, 65535), (1, 7, 8, 9, 10)]
    a, b = (int(ipaddress.IPv6Address(x)) for x in ("2001:db8::1", "ff02::2"))
    (tmp_path / "b.vec").write_bytes(struct.pack("<QQQQHHI", a & (2**64 - 1), a >> 64, b & (2**64 - 1), b >> 64, 1, 2, 0))
    r = packets.binary_vector(spark, str(tmp_path / "b.vec"), "flow6").first()
    assert bytes(r["src_ip6"]) == a.to_bytes(16, "big") and bytes(r["dst_ip6"]) == b.to_bytes(16, "big") and (r["src_port"], r["dst_port"]) == (1, 2)
    (tmp_path / "c.vec").write_bytes(np.array([5, 2**40], "<u8").tobytes())
    assert [r["value"] for r in packets.binary_vector(spark, str(tmp_path / "c.vec"), "u64").collect()] == [5, 2**40]


def test_text_flows(spark, tmp_path):
    (tmp_path / "f.txt").write_text("('10.0.0.1', 80, '10.0.0.2', 8080): 12\nnoise\n('2001:db8:0:0:0:0:0:1', 1, 'ff02:0:0:0:0:0:0:2', 2): 3\n")
    rows = packets.flow_text(spark, str(tmp_path / "f.txt")).collect()
    assert len(rows) == 2 and (rows[0]["src_ip"], rows[0]["dst_port"], rows[0]["packets"]) == (167772161, 8080, 12)
    assert rows[1]["src_ip"] is None and bytes(rows[1]["dst_ip6"]) == ipaddress.IPv6Address("ff02::2").packed


def test_offsets_don_t_depend_on_blocks(spark, sf):
    rows = packets.packets(spark, sf)
    a = {(r["seq"], r["off"]) for r in packets.with_offsets(rows).select("seq", "off").collect()}
    assert a == {(r["seq"], r["off"]) for r in packets.with_offsets(rows, block_rows=37).select("seq", "off").collect()}


def test_capture_files(spark, tmp_path):
    rows = spark.createDataFrame([(1_700_000_000_123_456, bytearray(V4), 60), (1_700_000_001_000_000, bytearray(b""), 0), (5, bytearray(V6), 44)], "ts_us long, payload binary, len int").coalesce(1)
    path = f"{tmp_path}/out"
    pcap.write_pcap(rows, path)
    for back in (pcap.read_pcap(spark, f"{path}/*.pcap"), pcap.register(spark).read.format("pcap").load(path)):
        got = sorted((r["ts_us"], bytes(r["payload"]), r["caplen"], r["len"]) for r in back.collect())
        assert got == [(5, V6, len(V6), 44), (1_700_000_000_123_456, V4, len(V4), 60), (1_700_000_001_000_000, b"", 0, 0)]
    source = spark.read.format("pcap").load(path)
    assert source.where("ts_us > 5 AND ts_us <= 1700000000123456").count() == 1
    assert pcap.decoded(source).where("version = 6").count() == 1


def test_foreign_capture_files(spark, tmp_path):
    ether = b"\0" * 12 + b"\x08\x00" + V4
    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 7, 5_000, len(ether), len(ether)) + ether + struct.pack(">IIII", 8, 0, 99, 99) + b"cut"
    (tmp_path / "big.pcap").write_bytes(big)
    (r,) = pcap.decoded(pcap.read_pcap(spark, str(tmp_path / "big.pcap"))).collect()
    assert (r["ts_us"], r["src_port"], r["off"], r["caplen"]) == (7_000_005, 443, 24, len(V4))
    with pytest.raises(ValueError):
        list(pcap.records(b"x" * 40))
