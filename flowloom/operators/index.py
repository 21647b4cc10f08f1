"""Secondary indexes as tables: postings, compact blocks, prefix, Bloom and bitmap lookups, and clustered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.zorder import interleave, sortable, split_box
from flowloom.schema import INDEXES

#: Packets (by order of arrival) of one block, which bounds a posting list.
BLOCK = 4096


def postings(heads: DataFrame, index_id: int) -> DataFrame:
    """key, rx_id, off, ts_us of each head, for one index of the catalogue; the key of a 4-tuple is a struct, ordered by its fields."""
    columns = INDEXES[index_id][1]
    key = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return heads.select(key.alias("key"), "rx_id", "off", "ts_us", "seq")


def compact(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, key, n and the sorted addresses of a key in a block: a list has no more entries than a block has packets."""
    at = F.floor(F.col("seq") / block).alias("block")
    return posted.groupBy(at, "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rx_id", "off"))).alias("at"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("key", F.explode("at").alias("p")).select("key", "p.rx_id", "p.off")


def point(blocks: DataFrame, key) -> DataFrame:
    return _flat(blocks.where(F.col("key") == F.lit(key)))


def between(blocks: DataFrame, lo, hi) -> DataFrame:
    """Both ends included."""
    return _flat(blocks.where(F.col("key").between(F.lit(lo), F.lit(hi))))


def half_open(blocks: DataFrame, lo, hi) -> DataFrame:
    """From lo on, hi excluded."""
    return _flat(blocks.where((F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi))))


def with_prefix(blocks: DataFrame, prefix: bytes) -> DataFrame:
    """Binary keys that begin with the bytes given: a range, so files sorted by key are pruned."""
    after = (int.from_bytes(prefix, "big") + 1).to_bytes(len(prefix) + 1, "big")
    above = F.lit(True) if after[0] else F.col("key") < F.lit(after[1:])
    return _flat(blocks.where((F.col("key") >= F.lit(prefix)) & above))


def intersect(*found: DataFrame) -> DataFrame:
    """Addresses that all lookups share; empty if one is empty."""
    out = found[0].select("rx_id", "off").distinct()
    for other in found[1:]:
        out = out.join(other.select("rx_id", "off"), ["rx_id", "off"], "left_semi")
    return out


def intersect_ranges(heads: DataFrame, ranges: dict[int, tuple[int, int]]) -> DataFrame:
    """Addresses of heads that lie in a range of each of several numeric indexes, both ends included: one pass over all postings."""
    postings = F.explode(F.array(*(F.struct(F.lit(k).alias("index_id"), F.col(INDEXES[k][1][0]).cast("long").alias("key")) for k in ranges)))
    found = F.lit(False)
    for k, (lo, hi) in ranges.items():
        found = found | ((F.col("p.index_id") == k) & F.col("p.key").between(lo, hi))
    return heads.select("rx_id", "off", postings.alias("p")).where(found).groupBy("rx_id", "off").agg(F.countDistinct("p.index_id").alias("n")).where(F.col("n") == len(ranges)).select("rx_id", "off")


def union(*found: DataFrame) -> DataFrame:
    """Addresses that any lookup has, once each."""
    out = found[0].select("rx_id", "off")
    for other in found[1:]:
        out = out.union(other.select("rx_id", "off"))
    return out.distinct()


def write(blocks: DataFrame, path: str, partitions: int, bloom: bool = True, distinct: int = 1_000_000) -> None:
    """Files sorted by key over ranges of keys, with min/max statistics and, for point lookups, Parquet Bloom filters."""
    writer = blocks.repartitionByRange(partitions, "key").sortWithinPartitions("key").write.mode("overwrite")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", distinct)
    writer.parquet(path)


def bitmaps(rows: DataFrame, key: str, id: str) -> DataFrame:
    """key, bucket, bitmap of ids: one bitmap of 32,768 places a bucket, merged with bitmap_or_agg."""
    return rows.groupBy(key, F.bitmap_bucket_number(id).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id)).alias("bitmap"))


def bitmap_counts(maps: DataFrame, key: str) -> DataFrame:
    return maps.groupBy(key).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket and the number of ids that both sides of single keys hold, by intersecting the bitmaps' bytes."""
    x, y = a.select("bucket", F.hex("bitmap").alias("x")), b.select("bucket", F.hex("bitmap").alias("y"))
    words = F.transform(F.sequence(F.lit(1), F.least(F.length("x"), F.length("y")), F.lit(8)), lambda i: F.bit_count(F.conv(F.substring("x", i, F.lit(8)), 16, 10).cast("long").bitwiseAND(F.conv(F.substring("y", i, F.lit(8)), 16, 10).cast("long"))))
    return x.join(y, "bucket").select("bucket", F.aggregate(words, F.lit(0), lambda s, v: s + v).cast("long").alias("n"))


def block_ranges(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Time and offset range of each block of a queue."""
    return packets.groupBy("rx_id", F.floor(F.col("seq") / block).alias("block")).agg(F.min("ts_us").alias("time_start"), F.max("ts_us").alias("time_end"), F.min("off").alias("off_start"), F.max("off").alias("off_end"), F.count("*").alias("n"))


def prune_blocks(ranges: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Blocks that can hold packets of a time range, both ends included; None is open."""
    test = F.lit(True)
    if start_us is not None:
        test = test & (F.col("time_end") >= start_us)
    if end_us is not None:
        test = test & (F.col("time_start") <= end_us)
    return ranges.where(test)


def write_clustered(packets: DataFrame, path: str, x: str, y: str, partitions: int) -> None:
    """Files over ranges of z, sorted by z, so that box queries skip files and row groups."""
    z = sortable(interleave(F.col(x), F.col(y)))
    packets.withColumn("z", z).repartitionByRange(partitions, "z").sortWithinPartitions("z").write.mode("overwrite").parquet(path)


def box(table: DataFrame, x: str, y: str, x0: int, y0: int, x1: int, y1: int, z: str | None = None, bits: int = 16) -> DataFrame:
    """Rows of a rectangle, ends included: z ranges prune where the table has z, the exact test decides."""
    exact: Column = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    if z:
        ranges = F.lit(False)
        for lo, hi in split_box(x0, y0, x1, y1, bits):
            a, b = (v - (1 << 63) for v in (lo, hi))
            ranges = ranges | F.col(z).between(F.lit(a), F.lit(b))
        exact = exact & ranges
    return table.where(exact)
