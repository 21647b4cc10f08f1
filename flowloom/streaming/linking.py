"""Flow linking and tag sums over streams of packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import GAP_BYTES, GAP_US
from flowloom.schema import FLOW

#: The session option that stateful linking needs, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KEY = ["rx_id", *FLOW]
OUTPUT = "rx_id int, src_ip long, dst_ip long, src_port int, dst_port int, seq long, off long, is_head int, segment long, prev_off long, flow_bytes long"
#: Flows are kept together by a hash of queue and flow, in so many groups; a checkpoint holds for one number.
GROUPS = 256
#: A flow's last packet, chain number, byte count, and the time of its last batch in milliseconds.
STATE = pa.schema([("rx_id", pa.int32()), ("src_ip", pa.int64()), ("dst_ip", pa.int64()), ("src_port", pa.int32()), ("dst_port", pa.int32())] + [(c, pa.int64()) for c in ("off", "ts_us", "segment", "total", "at")])


def link_rows(packets: pd.DataFrame, state: pd.DataFrame, gap_bytes: int, gap_us: int, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Packets of any number of flows linked to each other and to their flows' state, and the new state of all these flows."""
    n = len(state)
    join = lambda a, b: np.concatenate([state[a].to_numpy("int64"), packets[b].to_numpy("int64")])
    flows = pd.concat([state[KEY].astype("Int64"), packets[KEY].astype("Int64")], ignore_index=True)
    code = flows.groupby(KEY, sort=False, dropna=False).ngroup().to_numpy()
    seq = packets["seq"].to_numpy("int64")
    order = np.lexsort((np.concatenate([np.zeros(n, "int64"), seq]), np.arange(len(code)) >= n, code))
    code, old = code[order], order < n
    off, ts, bytes_ = join("off", "off")[order], join("ts_us", "ts_us")[order], join("total", "caplen")[order]
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    head = first | (np.diff(off, prepend=off[:1]) > gap_bytes) | (np.diff(ts, prepend=ts[:1]) > gap_us)
    begun = np.flatnonzero(first)

    def running(x: np.ndarray) -> np.ndarray:
        """Sums from the first row of each flow on; a row of state brings its own."""
        total = np.cumsum(x)
        return total - np.repeat(total[begun] - x[begun], np.diff(begun, append=len(x)))

    heads = head.astype("int64")
    heads[old] = state["segment"].to_numpy("int64")[order[old]]
    done = flows.iloc[order].reset_index(drop=True)
    done["off"], done["ts_us"], done["is_head"], done["segment"], done["total"] = off, ts, head.astype("int32"), running(heads), running(bytes_)
    done["at"] = np.concatenate([state["at"].to_numpy("int64"), np.full(len(packets), now)])[order]
    kept = done[np.append(first[1:], True)[: len(code)]]
    linked = done[~old].rename(columns={"total": "flow_bytes"})
    linked["seq"] = seq[order[~old] - n]
    linked["prev_off"] = pd.Series(np.append(0, off)[:-1][~old], index=linked.index, dtype="Int64").where(~head[~old])
    return linked[[c.split()[0] for c in OUTPUT.split(", ")]], kept[STATE.names]


class Linker(StatefulProcessor):
    """The state of a group of flows; a packet is linked to the one before it in its flow, which it names by prev_off.

    A batch's rows of a flow are put in order before they are linked; a flow's state goes after ttl_ms without packets, if given.
    One call does all flows of a group, as a call and an access to state cost milliseconds and flows have few packets a batch."""

    def __init__(self, gap_bytes: int, gap_us: int, ttl_ms: int | None):
        self.gap_bytes, self.gap_us, self.ttl_ms = gap_bytes, gap_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("flows", "flows binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        held = self.last.get()
        state = pa.ipc.open_stream(bytes(held[0])).read_all() if held else STATE.empty_table()
        if self.ttl_ms:
            state = state.filter(pc.greater(state["at"], now - self.ttl_ms))
        state = state.to_pandas(types_mapper={pa.int32(): pd.Int64Dtype(), pa.int64(): pd.Int64Dtype()}.get)
        linked, state = link_rows(pd.concat(list(rows)), state, self.gap_bytes, self.gap_us, now)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, STATE) as out:
            out.write_table(pa.Table.from_pandas(state, STATE, preserve_index=False))
        self.last.update((sink.getvalue().to_pybytes(),))
        yield linked

    def close(self) -> None:
        pass


def link_stream(packets: DataFrame, gap_bytes: int = GAP_BYTES, gap_us: int = GAP_US, ttl_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """A stream of packets (rx_id, flow, seq, off, ts_us, caplen) as linked packets; state is kept by queue and flow, and stored by group.

    A batch reads and writes the groups that its packets fall in, each with all its flows: many millions of flows need more groups.
    The query needs the RocksDB state store: run_available() sets it, other callers set STORE in their session."""
    rows = packets.select(F.pmod(F.xxhash64(*KEY), F.lit(groups)).cast("int").alias("group"), *KEY, "seq", "off", "ts_us", "caplen")
    return rows.groupBy("group").transformWithStateInPandas(Linker(gap_bytes, gap_us, ttl_ms), OUTPUT, "Append", "ProcessingTime" if ttl_ms else "None")


def window_counts(packets: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Packets and bytes by time window and queue, with a watermark for late packets."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "rx_id").agg(F.count("*").alias("packets"), F.sum("caplen").alias("bytes"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there into Parquet files, stop, and read them."""
    spark: SparkSession = stream.sparkSession
    was = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], was)
    return spark.read.schema(stream.schema).parquet(path)


def index_stream(packets: DataFrame, path: str, checkpoint: str, columns: list[str], partitions: int):
    """Write each micro-batch as index files: postings of each column, sorted by key; a batch that is run again replaces its own files."""

    def flush(batch: DataFrame, number: int) -> None:
        for c in columns:
            posted = batch.select(F.col(c).alias("key"), "rx_id", "off", "ts_us")
            posted.repartitionByRange(partitions, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/{c}/batch={number}")

    return packets.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
