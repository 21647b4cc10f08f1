"""Flow linking: chains of packets, their heads, and whole chains from heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.schema import FLOW, TAIL

#: A chain breaks where the gap is larger.
GAP_BYTES, GAP_US = 65536, 259_200_000_000


def link(packets: DataFrame, gap_bytes: int = GAP_BYTES, gap_us: int = GAP_US, flow: list[str] = FLOW) -> DataFrame:
    """packets with is_head, segment, and flow_next_diff (bytes to the chain's next packet, or the tail mark).

    One sort by queue, flow and order serves all windows. Chains are linked within a queue, as each queue has its own log."""
    w = Window.partitionBy("rx_id", *flow).orderBy("seq")
    gap = (F.lag("off").over(w).isNull()) | (F.col("off") - F.lag("off").over(w) > gap_bytes) | (F.col("ts_us") - F.lag("ts_us").over(w) > gap_us)
    headed = packets.withColumn("is_head", gap.cast("int"))
    linked = headed.withColumns({"segment": F.sum("is_head").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"), "next_head": F.lead("is_head").over(w), "next_off": F.lead("off").over(w)})
    diff = F.when(F.col("next_head") == 0, F.col("next_off") - F.col("off")).otherwise(F.lit(TAIL).cast("long"))
    return linked.withColumn("flow_next_diff", diff).drop("next_head", "next_off")


def heads(linked: DataFrame) -> DataFrame:
    return linked.where("is_head = 1")


def chains(linked: DataFrame, flow: list[str] = FLOW) -> DataFrame:
    """One row a chain: flow, segment, head offset, packets, bytes and time range."""
    return linked.groupBy("rx_id", *flow, "segment").agg(F.min("off").alias("head_off"), F.count("*").alias("packets"), F.sum("caplen").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def expand(linked: DataFrame, found: DataFrame, flow: list[str] = FLOW) -> DataFrame:
    """All packets of the chains that found heads begin."""
    return linked.join(found.select("rx_id", *flow, "segment").distinct(), ["rx_id", *flow, "segment"], "left_semi")


def fetch(packets: DataFrame, pointers: DataFrame, keys: tuple[str, ...] = ("rx_id", "off")) -> DataFrame:
    """The packets that pointers address."""
    return packets.join(pointers.select(*keys), list(keys), "left_semi")


def rss(packets: DataFrame, queues: int, flow: list[str] = FLOW) -> DataFrame:
    """queue: a hash of the flow, so that a flow stays on one queue."""
    return packets.withColumn("queue", F.pmod(F.hash(*flow), F.lit(queues)))
