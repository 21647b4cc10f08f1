"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone, with no ring or table. Appending a shard moves keys
only into it, about 1/(n+1) of them. Slots number a shard's rows without gaps: rows are counted by (shard, piece), where
the number of pieces follows the table's size and a piece is a hash of key, content and a running number, so neither a
shard nor a repeated row gathers in one task; then each piece numbers its own rows from the sum of those before it.

Edge cases: a null key hashes as the empty text; null text has size 1 and CRC-32 0, as has empty text; repeated rows get
slots of their own in the same shard; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, store

ROWS_A_PIECE = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, all keys at once; log(shards) rounds are to be expected."""
    key, b, j = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(todo):
            b[todo] = j[todo]
            key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
            j[todo] = ((b[todo] + 1) * (float(1 << 31) / ((key[todo] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            todo = todo[j[todo] < shards]
    return b


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a column of 64-bit hashes; call stable_key() for other keys."""

    @F.pandas_udf("int")
    def shard(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in parts:
            yield pd.Series(jump(hashes.to_numpy().view(np.uint64), shards), dtype="int32")

    return shard(key)


def stable_key(key: Column) -> Column:
    """64 bits of the key's text."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))


def assign(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and a struct (size, text_crc32, shard, grown_shard, slot); returns it and the struct's name."""
    carry = docs.columns if carry is None else carry
    (name,) = fresh(docs, "place")
    bytes_ = F.coalesce(docs[text], F.lit("")).cast("binary")
    key = stable_key(docs[id])
    light = docs.select(*(docs[c] for c in carry), key.alias(f"{name}_key"), (F.octet_length(bytes_) + 1).cast("long").alias(f"{name}_size"), F.crc32(bytes_).alias(f"{name}_crc"))
    placed = light.select("*", jump_shard(F.col(f"{name}_key"), shards).alias(f"{name}_s"), jump_shard(F.col(f"{name}_key"), shards + 1).alias(f"{name}_g"), F.monotonically_increasing_id().alias(f"{name}_row"))
    placed = store(placed, "placed")  # from here on a row's running number is fixed
    pieces = max(1, -(-placed.count() // (ROWS_A_PIECE * shards)))
    piece = F.pmod(F.xxhash64(f"{name}_key", f"{name}_crc", F.pmod(F.col(f"{name}_row"), F.lit(997))), F.lit(max(pieces, 8))).cast("int")
    placed = placed.withColumn(f"{name}_p", piece)
    shard, part = F.col(f"{name}_s"), F.col(f"{name}_p")
    counts = placed.groupBy(shard, part).agg(F.count("*").alias("n"))  # one row a piece
    base = F.coalesce(F.sum("n").over(Window.partitionBy(f"{name}_s").orderBy(f"{name}_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = store(counts.select(shard, part, base.cast("long").alias(f"{name}_base")), "bases")
    own = F.row_number().over(Window.partitionBy(shard, part).orderBy(f"{name}_key", f"{name}_crc", f"{name}_row"))
    joined = placed.withColumn(f"{name}_own", own).join(bases, [f"{name}_s", f"{name}_p"])
    out = F.struct(F.col(f"{name}_size").alias("size"), F.col(f"{name}_crc").alias("text_crc32"), shard.alias("shard"), F.col(f"{name}_g").alias("grown_shard"), (F.col(f"{name}_base") + F.col(f"{name}_own") - 1).cast("long").alias("slot"))
    return joined.select(*(F.col(f"`{c}`") for c in carry), out.alias(name)), name


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write docs as one Parquet folder a shard (path/shard=K), rows of a shard in several files of bounded size."""
    placed, name = assign(docs, shards, **options)
    (shard,) = fresh(placed, "shard")
    placed.withColumn(shard, F.col(name)["shard"]).drop(name).repartition(shard, F.pmod(F.monotonically_increasing_id(), F.lit(8))).write.option("maxRecordsPerFile", 1_000_000).partitionBy(shard).parquet(path)


def grow(docs: DataFrame, path: str, shards: int, id: str = "doc_id") -> DataFrame:
    """The rows of docs that leave their shard when one more is appended; all of them go to the new shard."""
    (was, now) = fresh(docs, "was", "now")
    key = stable_key(docs[id])
    return docs.select("*", jump_shard(key, shards).alias(was), jump_shard(key, shards + 1).alias(now)).where(F.col(was) != F.col(now)).drop(was, now)
