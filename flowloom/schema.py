"""Tables, index catalogue and constants of the packet model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the capture-file format: global header 24 bytes, record header 16; raw-IP link type.
FILE_HEADER, RECORD_HEADER, LINK_RAW_IP, LINK_ETHERNET, PCAP_MAGIC, SNAP = 24, 16, 101, 1, 0xA1B2C3D4, 65535
#: The link of a chain's last packet.
TAIL = 4294967295

#: Built-in indexes by id, with the columns that make their key; tag t has id 8 + t - 1.
INDEXES = {
    0: ("src_ip", ["src_ip"]), 1: ("dst_ip", ["dst_ip"]), 2: ("src_port", ["src_port"]), 3: ("dst_port", ["dst_port"]),
    4: ("src_ip6", ["src_ip6"]), 5: ("dst_ip6", ["dst_ip6"]),
    6: ("quad", ["src_ip", "dst_ip", "src_port", "dst_port"]), 7: ("quad6", ["src_ip6", "dst_ip6", "src_port", "dst_port"]),
}
FIRST_TAG_INDEX, MAX_TAGS = 8, 16

FLOW = ["src_ip", "dst_ip", "src_port", "dst_port"]

CAPTURE = T.StructType([
    T.StructField("ts_us", T.LongType()), T.StructField("caplen", T.IntegerType()), T.StructField("len", T.IntegerType()),
    T.StructField("file", T.StringType()), T.StructField("off", T.LongType()), T.StructField("payload", T.BinaryType()),
])
