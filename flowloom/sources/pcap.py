"""Capture files: a source and a sink.

Reading goes through Spark's binary files, so any store that Spark reaches will do, in batch and as a stream; a file is
parsed in one task, as its records can't be found from the middle. format("pcap") is the same as a Python data source, and
the sink: a file for each partition, whose records keep their order. No filter is pushed into that reader: it would keep
the filters of one query for the next query over the same table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from flowloom.functions.decode import packet_columns
from flowloom.schema import CAPTURE, FILE_HEADER, LINK_ETHERNET, LINK_RAW_IP, PCAP_MAGIC, RECORD_HEADER, SNAP

COLUMNS = "ts_us long, caplen int, len int, file string, off long, payload binary"
#: Magic numbers of either byte order, in micro- and nanoseconds.
_ORDERS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def records(data: memoryview | bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """ts_us, caplen, len, offset and layer-3 bytes of each record; a record that the file's end cuts off is left out."""
    data = memoryview(data)
    if len(data) < FILE_HEADER:
        return
    if bytes(data[:4]) not in _ORDERS:
        raise ValueError("no capture file")
    order, unit = _ORDERS[bytes(data[:4])]
    link = struct.unpack_from(f"{order}I", data, 20)[0]
    strip, at = 14 if link == LINK_ETHERNET else 0, FILE_HEADER
    while at + RECORD_HEADER <= len(data):
        sec, frac, cap, whole = struct.unpack_from(f"{order}IIII", data, at)
        body = at + RECORD_HEADER
        if body + cap > len(data):
            return
        yield sec * 1_000_000 + frac // unit, max(cap - strip, 0), max(whole - strip, 0), at, bytes(data[body + min(strip, cap) : body + cap])
        at = body + cap


def file_header(link: int = LINK_RAW_IP) -> bytes:
    return struct.pack("<IHHiIII", PCAP_MAGIC, 2, 4, 0, 0, SNAP, link)


def record(ts_us: int, payload: bytes, whole: int | None = None) -> bytes:
    return struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(payload), len(payload) if whole is None else whole) + payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held: list[tuple] = []
            for r in records(content.as_buffer()):
                held.append(r)
                if len(held) == 4096:
                    yield _batch(path, held)
                    held = []
            if held:
                yield _batch(path, held)


def _batch(path: str, held: list[tuple]) -> pa.RecordBatch:
    ts, cap, whole, off, payload = zip(*held, strict=True)
    return pa.RecordBatch.from_pydict({"ts_us": pa.array(ts, pa.int64()), "caplen": pa.array(cap, pa.int32()), "len": pa.array(whole, pa.int32()), "file": pa.array([path] * len(ts)), "off": pa.array(off, pa.int64()), "payload": pa.array(payload, pa.binary())})


def read_pcap(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured packets of files, as rows of ts_us, caplen, len, file, off, payload."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 8).load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(_parse, COLUMNS)


def decoded(captured: DataFrame) -> DataFrame:
    """Captured packets with their headers' columns."""
    return captured.select("*", *(c.alias(n) for n, c in packet_columns(F.col("payload")).items()))


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    part: str
    final: str
    packets: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_File(root)]
        return [_File(f.path) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: _File):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            data = f.read_buffer()
        for ts, cap, whole, off, payload in records(data):
            yield (ts, cap, whole, partition.path, off, payload)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, n = f"{root}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(part) as out:
            out.write(file_header())
            for r in rows:
                out.write(record(r.ts_us, bytes(r.payload), getattr(r, "len", None)))
                n += 1
        return _Written(part, f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}.pcap", n)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".pcap"):
                    fs.delete_file(f.path)
        for m in messages:
            if m.packets:
                fs.move(m.part, m.final)
            else:
                fs.delete_file(m.part)

    def abort(self, messages):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.part)


class PcapDataSource(DataSource):
    """format("pcap"): load(path) reads files or a folder; save(path) needs ts_us and payload, and uses len if it is there."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return CAPTURE

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make format("pcap") known to a session."""
    spark.dataSource.register(PcapDataSource)
    return spark


def write_pcap(packets: DataFrame, path: str) -> None:
    """A capture file of raw IP packets for each partition, in order of time inside it."""
    register(packets.sparkSession)
    columns = ["ts_us", "payload", *(["len"] if "len" in packets.columns else [])]
    packets.select(*columns).sortWithinPartitions("ts_us").write.format("pcap").mode("append").save(path)


def payload_of(packets: DataFrame) -> DataFrame:
    """packets with a payload: a minimal IPv4 and TCP header of their addresses, ports and flags, for round trips."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    size = F.greatest(F.col("caplen"), F.lit(40))
    ip = F.concat(F.lit("4500"), hexed(size, 4), F.lit("0000000040060000"), hexed(F.col("src_ip"), 8), hexed(F.col("dst_ip"), 8))
    tcp = F.concat(hexed(F.col("src_port"), 4), hexed(F.col("dst_port"), 4), F.lit("000000000000000050"), hexed(F.col("tcp_flags"), 2), F.lit("FFFF00000000"))
    return packets.withColumn("payload", F.unhex(F.concat(ip, tcp)))
