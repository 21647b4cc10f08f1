"""Linking streams of many flows, and of packets that lie unevenly over their numbers."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows
from flowloom.plans.queries import ORACLES, QUERIES
from flowloom.streaming import linking
from tests.oracle import assert_same


@pytest.fixture
def store(spark):
    was = spark.conf.get(linking.STORE[0])
    spark.conf.set(*linking.STORE)
    yield
    spark.conf.set(linking.STORE[0], was)


def test_many_flows_are_linked_in_few_calls(spark, store, tmp_path):
    n = 4000
    rows = spark.range(3 * n).select(
        F.col("id").alias("seq"), (F.col("id") * 100).alias("off"), (F.col("id") * 1000).alias("ts_us"), F.lit(50).cast("long").alias("caplen"),
        (F.col("id") % 4).cast("int").alias("rx_id"), (F.col("id") % n).alias("src_ip"), F.lit(7).cast("long").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"),
    )
    for k in range(3):
        rows.where(F.floor(F.col("seq") / n) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = linking.link_stream(stream, gap_bytes=100 * n).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["seq"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["seq"]: r for r in flows.link(rows, gap_bytes=100 * n).collect()}
    assert len(got) == len(want) == 3 * n and all((got[k]["is_head"], got[k]["segment"]) == (r["is_head"], r["segment"]) for k, r in want.items())
    assert all((r["prev_off"], r["flow_bytes"]) == (None if k < n else r["off"] - 100 * n, 50 * (k // n + 1)) for k, r in got.items())
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 1000  # calls and accesses to state, of 4000 flows


def test_unevenly_numbered_packets(spark, tmp_path):
    """One packet in the first third of the numbers, many blocks of them in the others, in as many files as a step has."""
    ids = [0, *range(1_000_000, 3_000_000, 20_000)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=k), 4 * (k % 2), "click", 1.5, '{"k": 7}') for k, i in enumerate(ids)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert_same(QUERIES["stream_flow_link"](spark, str(tmp_path)), ORACLES["stream_flow_link"], {"events": f"{path}/*.parquet"})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def linked_one_by_one(batches, gap_bytes, gap_us, ttl):
    out, state = [], {}
    for now, packets in batches:
        for r in packets.sort_values("seq").astype(object).to_dict("records"):
            key = tuple(None if pd.isna(r[c]) else int(r[c]) for c in linking.KEY)
            off, ts, segment, total, at = state.get(key, (None, None, 0, 0, now))
            if at <= now - ttl:
                off, ts, segment, total = None, None, 0, 0
            head = off is None or r["off"] - off > gap_bytes or r["ts_us"] - ts > gap_us
            state[key] = r["off"], r["ts_us"], segment + head, total + r["caplen"], now
            out.append((*key, r["seq"], r["off"], int(head), segment + head, None if head else off, total + r["caplen"]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_groups_as_one_by_one(seed):
    """Flows that come and go, without a queue, and forgotten after a time."""
    rng, ttl, batches, last = np.random.default_rng(seed), (15, 10**9)[seed % 2], [], 0
    for k in range(6):
        n = int(rng.integers(1, 80))
        packets = pd.DataFrame({c: rng.integers(0, 2, n) for c in linking.KEY}).assign(seq=last + np.arange(n), caplen=rng.integers(0, 99, n))
        packets["off"], packets["ts_us"] = (last + np.arange(n)) * 40 + rng.integers(0, 40, n), (last + np.arange(n)) * 50 + rng.integers(-90, 90, n)
        packets["rx_id"] = packets["rx_id"].where(rng.random(n) < 0.8)
        packets = packets[packets["src_ip"] == k % 2] if k > 2 else packets
        last += n
        batches += [(10 * k, packets.sample(frac=1, random_state=seed))] if len(packets) else []
    got, state = [], linking.STATE.empty_table().to_pandas().astype("Int64")
    for now, packets in batches:
        linked, state = linking.link_rows(packets, state[state["at"] > now - ttl], 400, 600, now)
        got += [tuple(None if pd.isna(x) else int(x) for x in r) for r in linked.itertuples(index=False)]
    assert sorted(got, key=lambda r: r[5]) == linked_one_by_one(batches, 400, 600, ttl)
