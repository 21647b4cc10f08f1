"""Tags: fields of packets aggregated by flow chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.decode import field
from flowloom.schema import FIRST_TAG_INDEX, FLOW, MAX_TAGS

#: Fixed codes of the aggregates.
SUM, MAX, MIN, DISTINCT = 2, 4, 5, 6


@dataclass(frozen=True)
class Tag:
    """A tag: id from 1, aggregate code, and its value, a Column, or a field of the packet's bytes by bits."""

    id: int
    agg: int
    value: Column | None = None
    bit_offset: int = 0
    bit_length: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.id <= MAX_TAGS:
            raise ValueError(f"tag ids are 1 to {MAX_TAGS}")

    def column(self) -> Column:
        return (field(F.col("payload"), self.bit_offset, self.bit_length) if self.value is None else self.value).cast("long")

    @property
    def index_id(self) -> int:
        return FIRST_TAG_INDEX + self.id - 1


def _aggregate(tag: Tag, value: Column) -> Column:
    return {SUM: F.sum(value), MAX: F.max(value), MIN: F.min(value)}.get(tag.agg, F.min_by(value, F.col("seq")))


def per_chain(linked: DataFrame, tags: list[Tag], flow: list[str] = FLOW) -> DataFrame:
    """Flow, segment, head offset and a column tag_<id> for each tag that isn't a distinct one; other codes keep the first value."""
    return linked.groupBy("rx_id", *flow, "segment").agg(F.min("off").alias("head_off"), *(_aggregate(t, t.column()).alias(f"tag_{t.id}") for t in tags if t.agg != DISTINCT))


def distinct_values(linked: DataFrame, tag: Tag, flow: list[str] = FLOW) -> DataFrame:
    """One row the first time that a flow shows a value: flow, value, and the offset of that packet and of its chain's head."""
    heads = linked.withColumn("head_off", F.max(F.when(F.col("is_head") == 1, F.col("off"))).over(Window.partitionBy("rx_id", *flow).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return heads.groupBy("rx_id", *flow, tag.column().alias("value")).agg(F.min(F.struct("seq", "off", "head_off")).alias("m")).select("rx_id", *flow, "value", F.col("m.off").alias("off"), F.col("m.head_off").alias("head_off"))


def cumulative(linked: DataFrame, tag: Tag, flow: list[str] = FLOW) -> DataFrame:
    """The aggregate as it stands whenever a chain breaks (with the breaking packet, at the old chain's head), and at a flow's end."""
    w = Window.partitionBy("rx_id", *flow).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    value = tag.column()
    run = {SUM: F.sum(value), MAX: F.max(value), MIN: F.min(value)}.get(tag.agg, F.first(value)).over(upto)
    head = F.max(F.when(F.col("is_head") == 1, F.col("off"))).over(upto)
    rows = linked.withColumns({"value": run.cast("long"), "head": head, "more": F.lead("seq").over(w)}).withColumn("old_head", F.lag("head").over(w))
    broken = rows.where("is_head = 1 AND segment > 1").select("rx_id", *flow, F.col("old_head").alias("head_off"), "value", F.lit("break").alias("event"))
    return broken.unionByName(rows.where("more IS NULL").select("rx_id", *flow, F.col("head").alias("head_off"), "value", F.lit("end").alias("event")))


def tag_postings(tagged: DataFrame, tags: list[Tag]) -> DataFrame:
    """index_id, key, rx_id, off: a posting of each chain's aggregates at its head."""
    each = F.explode(F.array(*(F.struct(F.lit(t.index_id).alias("index_id"), F.col(f"tag_{t.id}").alias("key")) for t in tags)))
    return tagged.select("rx_id", F.col("head_off").alias("off"), each.alias("p")).select("p.index_id", "p.key", "rx_id", "off")
