"""Packet tables: from the events table, from binary and text flow files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.decode import ip6_to_binary, ip_to_long
from flowloom.schema import FILE_HEADER, RECORD_HEADER

#: Rows of a queue whose offsets one task sums.
BLOCK_ROWS = 1 << 16

PORTS = {"click": 80, "error": 514, "purchase": 443, "signup": 8080}


def epoch_us_of(ts: Column) -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") if ts is None else F.unix_micros(ts.cast("timestamp"))


def with_offsets(packets: DataFrame, queue: str = "rx_id", seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """off: each packet's byte offset in its queue's log. Sums by (queue, block of seq) come first, so one queue is worked on in many tasks."""
    size = F.col("caplen") + RECORD_HEADER
    blocked = packets.withColumn("block", F.floor(F.col(seq) / block_rows))
    sums = blocked.groupBy(queue, "block").agg(F.sum(size).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(queue).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(queue, "block", (before + FILE_HEADER).cast("long").alias("base"))
    own = F.sum(size).over(Window.partitionBy(queue, "block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)) - size
    return blocked.withColumn("own", own).join(bases, [queue, "block"]).withColumn("off", (F.col("base") + F.col("own")).cast("long")).drop("block", "own", "base")


def from_events(events: DataFrame) -> DataFrame:
    """Packets of an events table: users are sources, event types destinations and services, value the length, a key in props the flags."""
    kind = F.col("event_type")
    number = F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(4)
    port = F.lit(53)
    for name, p in PORTS.items():
        port = F.when(kind == name, p).otherwise(port)
    user = F.col("user_id")
    rows = events.select(
        F.col("event_id").alias("seq"),
        epoch_us_of(None).cast("long").alias("ts_us"),
        F.pmod(user, F.lit(4)).cast("int").alias("rx_id"),
        (F.lit(167772160) + user).cast("long").alias("src_ip"),
        (F.lit(3232235520) + 256 * number).cast("long").alias("dst_ip"),
        (F.lit(1024) + F.pmod(user, F.lit(7))).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        (F.floor(F.col("value")) + 40).cast("long").alias("caplen"),
        F.pmod(F.regexp_extract("props", "([0-9]+)", 1).cast("long"), F.lit(64)).cast("int").alias("tcp_flags"),
        kind.alias("event_type"),
        F.unhex(F.concat(F.lit("20010DB8000000000000000000000000"[:24]), F.lpad(F.hex(user), 8, "0"))).alias("src_ip6"),
        F.unhex(F.concat(F.lit("20010DB80000000000000001"), F.lpad(F.hex(number.cast("long")), 8, "0"))).alias("dst_ip6"),
    )
    return rows


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def flow_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ('source', port, 'destination', port): count, with addresses of either version."""
    line = r"^\('([0-9A-Fa-f:.]+)', *(\d+), *'([0-9A-Fa-f:.]+)', *(\d+)\): *(\d+)"
    part = lambda k: F.regexp_extract("value", line, k)
    rows = spark.read.text(path).where(F.col("value").rlike(line)).select(*(part(k).alias(c) for k, c in ((1, "src"), (2, "sp"), (3, "dst"), (4, "dp"), (5, "n"))))
    return rows.select(
        ip_to_long(F.col("src")).alias("src_ip"), ip6_to_binary(F.col("src")).alias("src_ip6"), F.col("sp").cast("int").alias("src_port"),
        ip_to_long(F.col("dst")).alias("dst_ip"), ip6_to_binary(F.col("dst")).alias("dst_ip6"), F.col("dp").cast("int").alias("dst_port"), F.col("n").cast("long").alias("packets"),
    )


#: Records of binary vectors, little-endian as they lie in memory.
VECTORS = {
    "flow4": np.dtype([("src_ip", "<u4"), ("dst_ip", "<u4"), ("src_port", "<u2"), ("dst_port", "<u2")]),
    "flow6": np.dtype([("src_low", "<u8"), ("src_high", "<u8"), ("dst_low", "<u8"), ("dst_high", "<u8"), ("src_port", "<u2"), ("dst_port", "<u2"), ("pad", "<u4")]),
    "u64": np.dtype([("value", "<u8")]),
}


def write_vector(rows: DataFrame, path: str, kind: str = "flow4") -> int:
    """Write rows as packed records, a file a partition, whole or not at all; returns the number of records. path is a URI that tasks can write to."""
    record = VECTORS[kind]
    names = [n for n in record.names if n != "pad"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            data = np.zeros(len(batch), record)
            for k, n in enumerate(names):
                data[n] = batch.column(k).to_numpy(zero_copy_only=False)
            parts.append(data.tobytes())
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        own = f"{root}/part-{context.partitionId():05d}.vec"
        with fs.open_output_stream(f"{own}.{context.taskAttemptId()}.tmp") as out:
            out.write(b"".join(parts))
        fs.move(f"{own}.{context.taskAttemptId()}.tmp", own)
        yield pa.RecordBatch.from_pydict({"n": [sum(map(len, parts)) // record.itemsize]})

    return rows.select(*names).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def binary_vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Packed records of files, numbered from 0 in each; 64-bit values of 2^63 and above don't occur in counts and flags."""
    record = VECTORS[kind]
    schema = {"flow4": "src_ip long, dst_ip long, src_port int, dst_port int", "flow6": "src_ip6 binary, dst_ip6 binary, src_port int, dst_port int", "u64": "value long"}[kind]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), record)
                for lo in range(0, len(data), 65536):
                    d = data[lo : lo + 65536]
                    out = {"file": [name] * len(d), "i": np.arange(lo, lo + len(d))}
                    if kind == "flow6":
                        for side in ("src", "dst"):
                            both = np.stack([d[f"{side}_high"], d[f"{side}_low"]], axis=1).astype(">u8").tobytes()
                            out[f"{side}_ip6"] = [both[k : k + 16] for k in range(0, len(both), 16)]
                    for c in [c for c in record.names if c in schema and c not in out and c != "pad"]:
                        out[c] = d[c].astype(np.int32 if "port" in c else np.int64)
                    names = ["file", "i", *(x.split()[0] for x in schema.split(", "))]
                    yield pa.RecordBatch.from_pydict({c: out[c] for c in names})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, f"file string, i long, {schema}")
