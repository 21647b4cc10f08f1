"""Streams give what batches give."""

from pyspark.sql import functions as F

from flowloom.operators import flows
from flowloom.plans.queries import offset_packets
from flowloom.streaming import linking


def arrivals(spark, sf, path):
    rows = offset_packets(spark, sf)
    for k in range(3):
        rows.where(F.col("seq") % 3000 >= 0).where(F.floor(F.col("seq") / 400) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_linking_and_bytes(spark, sf, tmp_path):
    stream = arrivals(spark, sf, f"{tmp_path}/in")
    got = linking.run_available(linking.link_stream(stream), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    want = {r["seq"]: r for r in flows.link(offset_packets(spark, sf)).collect()}
    assert len(got) == len(want) and all((r["is_head"], r["segment"], r["off"]) == tuple(want[r["seq"]][c] for c in ("is_head", "segment", "off")) for r in got)
    assert sum(r["prev_off"] is None for r in got) == sum(r["is_head"] for r in want.values())
    total = max(r["flow_bytes"] for r in got)
    assert total == max(r["b"] for r in offset_packets(spark, sf).groupBy("rx_id", "src_ip", "dst_ip", "src_port", "dst_port").agg(F.sum("caplen").alias("b")).collect())


def test_windows(spark, sf, tmp_path):
    stream = linking.window_counts(arrivals(spark, sf, f"{tmp_path}/in"), width="30 days")
    rows = linking.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert set(rows.columns) == {"window", "rx_id", "packets", "bytes"}


def test_index_files(spark, sf, tmp_path):
    linking.index_stream(arrivals(spark, sf, f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/check", ["src_ip", "dst_port"], 2).awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/index/dst_port")
    assert back.where("key = 443").count() == offset_packets(spark, sf).where("dst_port = 443").count() and back.select("batch").distinct().count() == 3
