"""Filter queries over packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.decode import epoch_us
from flowloom.operators.flows import heads
from flowloom.plans.expr import compile_filter
from flowloom.schema import FLOW
from flowloom.sources.pcap import write_pcap


def time_range(start: str | None, end: str | None) -> Column:
    """Packets between two times in seconds ("sec.frac"), ends included; empty is open."""
    test = F.lit(True)
    if start:
        test = test & (F.col("ts_us") >= epoch_us(start))
    if end:
        test = test & (F.col("ts_us") <= epoch_us(end))
    return test


def select(packets: DataFrame, expression: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Packets that an expression and a time range allow. It is one filter, so Catalyst pushes it into the scan."""
    return packets.where(compile_filter(expression, packets.columns) & time_range(start, end))


def select_flows(linked: DataFrame, expression: str, start: str | None = None, end: str | None = None, expand_flows: bool = True, flow: list[str] = FLOW) -> DataFrame:
    """Packets of the chains whose heads an expression finds (or the heads alone), within a time range.

    A chain's packets take their head's verdict over the window that linking has sorted by: no join, no further shuffle."""
    test = compile_filter(expression, linked.columns)
    if not expand_flows:
        return heads(linked).where(test & time_range(start, end))
    upto = Window.partitionBy("rx_id", *flow).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    verdict = F.last(F.when(F.col("is_head") == 1, F.coalesce(test, F.lit(False))), ignorenulls=True).over(upto)
    (name,) = [n for n in ("found", "_found", "__found") if n not in linked.columns][:1]
    return linked.withColumn(name, verdict).where(F.col(name) & time_range(start, end)).drop(name)


def to_capture(linked: DataFrame, path: str, expression: str, start: str | None = None, end: str | None = None, expand_flows: bool = True) -> None:
    """Write what an expression and a time range find as capture files; linked has a payload column."""
    write_pcap(select_flows(linked, expression, start, end, expand_flows), path)
