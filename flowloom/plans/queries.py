"""Registered flow queries and the DuckDB SQL of the same rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import decode, zorder
from flowloom.operators import flows, index, query, tags
from flowloom.schema import FLOW, INDEXES
from flowloom.sources import pcap
from flowloom.sources.packets import binary_vector, flow_text, packets, with_offsets, write_vector
from flowloom.streaming import linking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The projection of events to packets, flow links and segments, in SQL.
PK = """
e AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id, event_type,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS t,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) + 40 AS caplen FROM events),
pk AS (SELECT seq, ts_us, user_id % 4 AS rx_id, 167772160 + user_id AS src_ip, 3232235520 + 256 * t AS dst_ip, 1024 + user_id % 7 AS src_port,
    CASE t WHEN 0 THEN 80 WHEN 1 THEN 514 WHEN 2 THEN 443 WHEN 3 THEN 8080 ELSE 53 END AS dst_port, caplen, k % 64 AS tcp_flags, event_type,
    '20010DB80000000000000000' || lpad(upper(hex(user_id)), 8, '0') AS src6, '20010DB80000000000000001' || lpad(upper(hex(t)), 8, '0') AS dst6,
    24 + CAST(sum(16 + caplen) OVER (PARTITION BY user_id % 4 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) - 16 - caplen AS off FROM e)"""
LK = f"""{PK},
lk AS (SELECT *, lag(off) OVER w AS prev_off, lag(ts_us) OVER w AS prev_ts FROM pk WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq)),
br AS (SELECT *, CASE WHEN prev_off IS NULL OR off - prev_off > {flows.GAP_BYTES} OR ts_us - prev_ts > {flows.GAP_US} THEN 1 ELSE 0 END AS is_head FROM lk),
sg AS (SELECT *, CAST(sum(is_head) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM br)"""
FLOWS = "rx_id, src_ip, dst_ip, src_port, dst_port"


def registered(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a temporary one where it is unset), removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(shared or f'file://{tempfile.gettempdir()}').rstrip('/')}/flowloom-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    atexit.register(remove)
    return path


@registered(f"WITH {PK} SELECT seq, ts_us, rx_id, src_ip, dst_ip, src_port, dst_port, caplen, tcp_flags, off FROM pk")
def packets_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_offsets(packets(spark, sf_dir)).select("seq", "ts_us", "rx_id", "src_ip", "dst_ip", "src_port", "dst_port", "caplen", "tcp_flags", "off")


@registered(f"WITH {PK} SELECT rx_id, count(*) AS packets, CAST(sum(caplen) AS BIGINT) AS bytes, CAST(max(off + 16 + caplen) AS BIGINT) AS log_bytes FROM pk GROUP BY rx_id")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_packets(spark, sf_dir).groupBy("rx_id").agg(F.count("*").alias("packets"), F.sum("caplen").alias("bytes"), F.max(F.col("off") + 16 + F.col("caplen")).alias("log_bytes"))


def offset_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_offsets(packets(spark, sf_dir))


def linked_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.link(offset_packets(spark, sf_dir))


#: Filter expressions, by query, with their SQL condition.
FILTERS = {
    "point_srcip": ("srcip == 10.0.0.5", "src_ip = 167772165"),
    "point_dstip": ("dstip == 192.168.2.0", "dst_ip = 3232236032"),
    "point_srcport": ("srcport == 1026", "src_port = 1026"),
    "point_dstport": ("dstport == 443", "dst_port = 443"),
    "point_quad": ("srcip == 10.0.0.5 && dstip == 192.168.0.0 && srcport == 1029 && dstport == 80", "src_ip = 167772165 AND dst_ip = 3232235520 AND src_port = 1029 AND dst_port = 80"),
    "cidr_srcip": ("srcip == 10.0.0.16/28", "src_ip BETWEEN 167772176 AND 167772191"),
    "cidr_dstip": ("dstip == 192.168.0.0/23", "dst_ip BETWEEN 3232235520 AND 3232236031"),
    "range_port": ("dstport >= 443 && dstport <= 514", "dst_port BETWEEN 443 AND 514"),
    "v6_point": ("srcip == 2001:db8::5", "src6 = '20010DB8000000000000000000000005'"),
    "v6_prefix96": ("dstip == 2001:db8:0:0:0:1::/96", "dst6 BETWEEN '20010DB8000000000000000100000000' AND '20010DB80000000000000001FFFFFFFF'"),
    "bool_and": ("srcport == 1026 && dstport == 443", "src_port = 1026 AND dst_port = 443"),
    "bool_or": ("srcport == 1026 || dstport == 443", "src_port = 1026 OR dst_port = 443"),
    "bool_paren": ("(srcip == 10.0.0.5 || dstport == 443) && dstip == 192.168.0.0/23", "(src_ip = 167772165 OR dst_port = 443) AND dst_ip BETWEEN 3232235520 AND 3232236031"),
    "bool_left_assoc": ("dstport == 443 || dstport == 80 && srcport == 1026", "(dst_port = 443 OR dst_port = 80) AND src_port = 1026"),
    "ext_not": ("!(dstport == 443) && srcip != 10.0.0.5", "NOT dst_port = 443 AND src_ip <> 167772165"),
    "ext_xor": ("srcport == 1026 ^^ dstport == 443", "(src_port = 1026) <> (dst_port = 443)"),
    "ext_compare": ("caplen > 60 && flags < 32", "caplen > 60 AND tcp_flags < 32"),
    "ext_in": ("dstport in {53, 8080} && srcip in {10.0.0.1, 10.0.0.8/29}", "dst_port IN (53, 8080) AND (src_ip = 167772161 OR src_ip BETWEEN 167772168 AND 167772175)"),
    "ext_contains": ('type contains "ig"', "contains(event_type, 'ig')"),
    "ext_slice": ('type[0:2] == "pu" || type[::2] == "cik"', "event_type[1:2] = 'pu' OR event_type = 'click'"),
}


def _filter(expression: str) -> Query:
    return lambda spark, sf_dir: query.select(packets(spark, sf_dir), expression).select("seq", "src_ip", "dst_ip", "src_port", "dst_port")


for _name, (_expression, _sql) in FILTERS.items():
    registered(f"WITH {PK} SELECT seq, src_ip, dst_ip, src_port, dst_port FROM pk WHERE {_sql}", _name)(_filter(_expression))


@registered("SELECT event_id AS seq FROM events WHERE epoch_us(ts) BETWEEN (SELECT epoch_us(min(ts)) FROM events) + 86400000000 AND (SELECT epoch_us(min(ts)) FROM events) + 172800000000 AND event_type = 'click'")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = packets(spark, sf_dir).agg(F.min("ts_us")).first()[0]
    at = lambda us: f"{us // 1_000_000}.{us % 1_000_000:06d}"
    return query.select(packets(spark, sf_dir), "dstport == 80", at(first + 86400000000), at(first + 172800000000)).select("seq")


RANGES = f"SELECT rx_id, seq // {index.BLOCK} AS block, min(ts_us) AS time_start, max(ts_us) AS time_end, min(off) AS off_start, max(off) AS off_end, count(*) AS n FROM pk GROUP BY ALL"


@registered(f"WITH {PK} {RANGES}")
def block_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.block_ranges(offset_packets(spark, sf_dir))


@registered(f"WITH {PK}, r AS ({RANGES}) SELECT rx_id, block, n FROM r WHERE time_end >= (SELECT min(ts_us) FROM pk) + 86400000000 AND time_start <= (SELECT min(ts_us) FROM pk) + 172800000000")
def block_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = packets(spark, sf_dir).agg(F.min("ts_us")).first()[0]
    return index.prune_blocks(index.block_ranges(offset_packets(spark, sf_dir)), first + 86400000000, first + 172800000000).select("rx_id", "block", "n")


@registered(f"WITH {LK}, n AS (SELECT *, lead(is_head) OVER w AS nh, lead(off) OVER w AS nx FROM sg WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq)) SELECT seq, rx_id, off, is_head, segment, CASE WHEN nh = 0 THEN nx - off ELSE 4294967295 END AS flow_next_diff FROM n")
def flow_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_packets(spark, sf_dir).select("seq", "rx_id", "off", "is_head", "segment", "flow_next_diff")


@registered(f"WITH {LK} SELECT {FLOWS}, segment, off, ts_us FROM sg WHERE is_head = 1")
def flow_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.heads(linked_packets(spark, sf_dir)).select("rx_id", "src_ip", "dst_ip", "src_port", "dst_port", "segment", "off", "ts_us")


@registered(f"WITH {LK}, h AS (SELECT src_ip, dst_ip, src_port, dst_port, segment FROM sg WHERE is_head = 1 AND (src_ip = 167772165 OR dst_port = 443) AND caplen > 60) SELECT sg.seq, sg.off FROM sg SEMI JOIN h USING (src_ip, dst_ip, src_port, dst_port, segment)")
def flow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.select_flows(linked_packets(spark, sf_dir), "srcip == 10.0.0.5 || dstport == 443 && caplen > 60").select("seq", "off")


@registered(f"WITH {LK} SELECT {FLOWS}, segment, min(off) AS head_off, count(*) AS packets, CAST(sum(caplen) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM sg GROUP BY ALL")
def flow_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.chains(linked_packets(spark, sf_dir))


for _name, _code, _sql in (("tag_sum", tags.SUM, "CAST(sum(caplen) AS BIGINT)"), ("tag_max", tags.MAX, "max(caplen)"), ("tag_min", tags.MIN, "min(caplen)"), ("tag_first", 0, "min_by(caplen, seq)")):
    registered(f"WITH {LK} SELECT {FLOWS}, segment, min(off) AS head_off, {_sql} AS tag_1 FROM sg GROUP BY {FLOWS}, segment", _name)(lambda spark, sf_dir, code=_code: tags.per_chain(linked_packets(spark, sf_dir), [tags.Tag(1, code, F.col("caplen"))]))


@registered(f"WITH {LK}, h AS (SELECT *, max(CASE WHEN is_head = 1 THEN off END) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ho FROM sg) SELECT {FLOWS}, tcp_flags AS value, min(off) AS off, arg_min(ho, seq) AS head_off FROM h GROUP BY {FLOWS}, tcp_flags")
def tag_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.distinct_values(linked_packets(spark, sf_dir), tags.Tag(2, tags.DISTINCT, F.col("tcp_flags")))


@registered(
    f"WITH {LK}, c AS (SELECT *, CAST(sum(caplen) OVER w AS BIGINT) AS value, max(CASE WHEN is_head = 1 THEN off END) OVER w AS head FROM sg WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq ROWS UNBOUNDED PRECEDING)), "
    f"d AS (SELECT *, lag(head) OVER w AS old_head, lead(seq) OVER w AS more FROM c WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY seq)) "
    f"SELECT {FLOWS}, old_head AS head_off, value, 'break' AS event FROM d WHERE is_head = 1 AND segment > 1 UNION ALL SELECT {FLOWS}, head, value, 'end' FROM d WHERE more IS NULL"
)
def tag_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.cumulative(linked_packets(spark, sf_dir), tags.Tag(1, tags.SUM, F.col("caplen")))


@registered(f"WITH {LK}, t AS (SELECT rx_id, src_ip, dst_ip, src_port, dst_port, segment, min(off) AS off, CAST(sum(caplen) AS BIGINT) AS s, max(tcp_flags) AS m FROM sg GROUP BY ALL) SELECT 8 AS index_id, s AS key, rx_id, off FROM t UNION ALL SELECT 9, m, rx_id, off FROM t")
def postings_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [tags.Tag(1, tags.SUM, F.col("caplen")), tags.Tag(2, tags.MAX, F.col("tcp_flags"))]
    return tags.tag_postings(tags.per_chain(linked_packets(spark, sf_dir), specs), specs)


_KEYS = {0: "src_ip::VARCHAR", 1: "dst_ip::VARCHAR", 2: "src_port::VARCHAR", 3: "dst_port::VARCHAR", 4: "src6", 5: "dst6", 6: "concat_ws(',', src_ip, dst_ip, src_port, dst_port)", 7: "concat_ws(',', src6, dst6, src_port, dst_port)"}


def _postings(index_id: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = index.compact(index.postings(flows.heads(linked_packets(spark, sf_dir)), index_id))
        columns = INDEXES[index_id][1]
        key = (F.hex("key") if columns[0].endswith("6") else F.col("key").cast("string")) if len(columns) == 1 else F.concat_ws(",", *(F.hex(f"key.{c}") if c.endswith("6") else F.col(f"key.{c}").cast("string") for c in columns))
        return blocks.select("block", key.alias("key"), "n", F.array_join(F.transform("at", lambda p: F.concat_ws(":", p["rx_id"].cast("string"), p["off"].cast("string"))), " ").alias("at"))

    return run


for _id, (_name, _) in INDEXES.items():
    registered(f"WITH {LK} SELECT seq // {index.BLOCK} AS block, {_KEYS[_id]} AS key, count(*) AS n, string_agg(rx_id || ':' || off, ' ' ORDER BY rx_id, off) AS at FROM sg WHERE is_head = 1 GROUP BY 1, 2", f"postings_{_name}")(_postings(_id))


def _lookups(spark: SparkSession, sf_dir: str):
    found = flows.heads(linked_packets(spark, sf_dir))
    blocks = lambda k: index.compact(index.postings(found, k))
    return index.between(blocks(0), 167772160, 167772190), index.point(blocks(3), 443)


@registered(f"WITH {LK} SELECT rx_id, off FROM sg WHERE is_head = 1 AND src_ip BETWEEN 167772160 AND 167772190 AND dst_port = 443 AND src_port BETWEEN 1025 AND 1028 AND dst_ip = 3232236032")
def postings_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = {0: (167772160, 167772190), 3: (443, 443), 2: (1025, 1028), 1: (3232236032, 3232236032)}
    return index.intersect_ranges(flows.heads(linked_packets(spark, sf_dir)), ranges)


@registered(f"WITH {LK} SELECT rx_id, off FROM sg WHERE is_head = 1 AND (src_ip BETWEEN 167772160 AND 167772190 OR dst_port = 443)")
def postings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.union(*_lookups(spark, sf_dir))


@registered(f"WITH {LK} SELECT seq, caplen FROM sg WHERE is_head = 1 AND src_ip BETWEEN 167772160 AND 167772190 AND dst_port = 443")
def pointer_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets fetched by the addresses that an index intersection gives."""
    return flows.fetch(offset_packets(spark, sf_dir), index.intersect(*_lookups(spark, sf_dir))).select("seq", "caplen")


@registered(f"WITH {LK} SELECT src6 AS key, rx_id, off FROM sg WHERE is_head = 1 AND src6 LIKE '20010DB80000000000000000000000%'")
def postings_prefix6(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = index.compact(index.postings(flows.heads(linked_packets(spark, sf_dir)), 4))
    return index.with_prefix(blocks, bytes.fromhex("20010DB80000000000000000000000")).select(F.hex("key").alias("key"), "rx_id", "off")


@registered(f"WITH {PK} SELECT seq, CAST(({' + '.join(f'(((src_port >> {k}) & 1) << {2 * k}) + (((dst_port >> {k}) & 1) << {2 * k + 1})' for k in range(16))}) AS BIGINT) AS z, src_port AS x, dst_port AS y FROM pk")
def zorder_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zorder.interleave(F.col("src_port"), F.col("dst_port"))
    x, y = zorder.decode(F.col("z"))
    return packets(spark, sf_dir).select("seq", z.alias("z")).select("seq", "z", x.alias("x"), y.alias("y"))


@registered(f"WITH {PK} SELECT seq, src_port, dst_port FROM pk WHERE src_port BETWEEN 1025 AND 1027 AND dst_port BETWEEN 50 AND 450")
def zorder_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle looked up in files that are clustered by z."""
    path = f"{scratch_dir(spark)}/clustered"
    index.write_clustered(packets(spark, sf_dir).select("seq", "src_port", "dst_port"), path, "src_port", "dst_port", 4)
    return index.box(spark.read.parquet(path), "src_port", "dst_port", 1025, 50, 1027, 450, "z").select("seq", "src_port", "dst_port")


@registered(f"WITH {PK} SELECT count(*) AS flows, 1 AS most_queues FROM (SELECT DISTINCT src_ip, dst_ip, src_port, dst_port FROM pk)")
def rss_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = flows.rss(packets(spark, sf_dir), 8).groupBy("src_ip", "dst_ip", "src_port", "dst_port").agg(F.max("queue").alias("a"), F.min("queue").alias("b"))
    return dealt.agg(F.count("*").alias("flows"), F.max(F.col("a") - F.col("b") + 1).alias("most_queues"))


@registered(f"WITH {PK} SELECT count(DISTINCT src_ip) AS src_ips, count(DISTINCT dst_ip) AS dst_ips, count(DISTINCT src_port) AS src_ports, count(DISTINCT tcp_flags) AS flags FROM pk")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).agg(*(F.countDistinct(c).alias(n) for c, n in (("src_ip", "src_ips"), ("dst_ip", "dst_ips"), ("src_port", "src_ports"), ("tcp_flags", "flags"))))


@registered(f"WITH {PK} SELECT dst_port, {', '.join(f'quantile_cont(caplen, {p / 10}) AS p{10 * p}' for p in range(11))} FROM pk GROUP BY dst_port")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("dst_port").agg(*(F.percentile("caplen", p / 10).alias(f"p{10 * p}") for p in range(11)))


@registered(f"WITH {PK} SELECT dst_port, count(DISTINCT seq) AS n FROM pk GROUP BY dst_port")
def bitmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bitmap_counts(index.bitmaps(packets(spark, sf_dir), "dst_port", "seq"), "dst_port")


@registered(f"WITH {PK} SELECT CAST(count(*) AS BIGINT) AS n FROM pk WHERE dst_port = 443 AND src_port = 1026")
def bitmap_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    one = lambda c, v: index.bitmaps(rows.where(F.col(c) == v), c, "seq")
    return index.bitmap_and(one("dst_port", 443), one("src_port", 1026)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@registered(f"WITH {LK}, d AS (SELECT seq // {index.BLOCK} AS block, src_ip, count(*) AS n FROM sg WHERE is_head = 1 GROUP BY 1, 2) SELECT CAST(sum(n) * 12 AS BIGINT) AS raw_bytes, CAST(count(*) * 8 + sum(n) * 8 AS BIGINT) AS compact_bytes FROM d")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of an address index as (key, pointer) pairs, and as keys with an offset into their pointers."""
    blocks = index.compact(index.postings(flows.heads(linked_packets(spark, sf_dir)), 0))
    return blocks.agg((F.sum("n") * 12).alias("raw_bytes"), (F.count("*") * 8 + F.sum("n") * 8).alias("compact_bytes"))


@registered(f"WITH {PK} SELECT seq, 4 AS version, src_ip, dst_ip, src_port, dst_port, tcp_flags, 6 AS protocol FROM pk")
def decode_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pcap.payload_of(packets(spark, sf_dir)).select("seq", "payload")
    return rows.select("seq", *(c.alias(n) for n, c in decode.packet_columns(F.col("payload")).items())).drop("src_ip6", "dst_ip6")


@registered(f"WITH {PK} SELECT rx_id, (rx_id * 281474976710656 + off)::VARCHAR AS pointer FROM pk")
def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_packets(spark, sf_dir).select("rx_id", decode.pointer(F.lit(0), F.col("rx_id"), F.col("off")).cast("string").alias("pointer"))


@registered(f"WITH {PK} SELECT ts_us, src_ip, dst_ip, src_port, dst_port, tcp_flags FROM pk")
def pcap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as capture files and read back."""
    path = f"{scratch_dir(spark)}/capture"
    pcap.write_pcap(pcap.payload_of(packets(spark, sf_dir)), path)
    return pcap.decoded(pcap.read_pcap(spark, f"{path}/*.pcap")).select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags")


@registered(f"WITH {LK} SELECT key, count(*) AS n FROM (SELECT src_ip AS key FROM sg WHERE is_head = 1) WHERE key IN (167772165, 167772170, 1) GROUP BY key")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups in index files that have Bloom filters."""
    path = f"{scratch_dir(spark)}/index"
    index.write(index.compact(index.postings(flows.heads(linked_packets(spark, sf_dir)), 0)), path, 4, distinct=10_000)
    return spark.read.parquet(path).where(F.col("key").isin(167772165, 167772170, 1)).groupBy("key").agg(F.sum("n").alias("n"))


@registered(f"WITH {LK} SELECT seq, off, is_head, segment FROM sg")
def stream_flow_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow linking as a stream over files of packets in order of arrival."""
    path = scratch_dir(spark)
    offset_packets(spark, sf_dir).write.parquet(f"{path}/all")
    rows = spark.read.parquet(f"{path}/all")
    last = rows.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # a flow's packets of one write lie in one file, so no batch has a later one without an earlier one
        rows.where(F.floor(F.col("seq") * 3 / (last + 1)) == k).repartition(2, "rx_id", *FLOW).write.mode("append").parquet(f"{path}/packets")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/packets")
    return linking.run_available(linking.link_stream(stream), f"{path}/out", f"{path}/checkpoint").select("seq", "off", "is_head", "segment")


def _payload6(rows: DataFrame) -> DataFrame:
    """A version 6 packet of each row: fixed header, then a TCP header with ports and flags."""
    number = lambda c, digits: F.lpad(F.hex(F.col(c).cast("long")), digits, "0")
    tcp = F.concat(number("src_port", 4), number("dst_port", 4), F.lit("00" * 8 + "50"), number("tcp_flags", 2), F.lit("00" * 6))
    return rows.withColumn("payload", F.unhex(F.concat(F.lit("60000000" + "0014" + "06" + "40"), F.hex("src_ip6"), F.hex("dst_ip6"), tcp)))


@registered(f"WITH {PK} SELECT seq, 6 AS version, src6, dst6, src_port, dst_port, tcp_flags, 6 AS protocol FROM pk")
def decode_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decode.packet_columns(F.col("payload"))
    own = (c[k].alias(k) for k in ("version", "src_port", "dst_port", "tcp_flags", "protocol"))
    return _payload6(packets(spark, sf_dir)).select("seq", *own, F.hex(c["src_ip6"]).alias("src6"), F.hex(c["dst_ip6"]).alias("dst6"))


@registered(f"WITH {PK} SELECT seq, 0 AS version, 0 AS src_port FROM pk WHERE seq % 4 IN (1, 2) UNION ALL SELECT seq, 4, src_port FROM pk WHERE seq % 4 = 0 UNION ALL SELECT seq, 4, 0 FROM pk WHERE seq % 4 = 3")
def non_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packets, address resolution frames, empty ones, and packets cut off after their IP header."""
    whole, kind = F.col("payload"), F.col("seq") % 4
    bytes_ = F.when(kind == 0, whole).when(kind == 1, F.unhex(F.lit("0001080006040001"))).when(kind == 2, F.unhex(F.lit(""))).otherwise(F.substring(whole, 1, 20))
    c = decode.packet_columns(F.col("payload"))
    return pcap.payload_of(packets(spark, sf_dir)).withColumn("payload", bytes_).select("seq", c["version"].alias("version"), F.coalesce(c["src_port"], F.lit(0)).alias("src_port"))


@registered(f"WITH {PK} SELECT seq, CAST(src_ip >> 16 AS BIGINT) AS net, CAST(6 AS BIGINT) AS proto, CAST(5 AS BIGINT) AS fixed, CAST(0 AS BIGINT) AS other FROM pk")
def tag_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 16 and 8 bits, a literal, and a length that isn't one of them."""
    cut = lambda at, bits, name: decode.field(F.col("payload"), at, bits).alias(name)
    return pcap.payload_of(packets(spark, sf_dir)).select("seq", cut(96, 16, "net"), cut(72, 8, "proto"), cut(5, 0, "fixed"), cut(8, 7, "other"))


@registered(f"WITH {PK} SELECT seq, concat_ws('.', src_ip >> 24, (src_ip >> 16) & 255, (src_ip >> 8) & 255, src_ip & 255) AS text, src_ip, src6 FROM pk")
def ip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = lambda k: F.regexp_replace(F.substring(F.lower(F.hex("src_ip6")), 4 * k + 1, 4), "^0{1,3}", "")
    six = F.concat(F.lit("2001:db8::"), group(6), F.lit(":"), group(7))  # a user takes the last two groups, from 65536 on both
    rows = packets(spark, sf_dir).select("seq", decode.long_to_ip(F.col("src_ip")).alias("text"), six.alias("six"))
    return rows.select("seq", "text", decode.ip_to_long(F.col("text")).alias("src_ip"), F.hex(decode.ip6_to_binary(F.col("six"))).alias("src6"))


@registered(f"WITH {PK} SELECT src_ip, src_port, dst_ip, dst_port, count(*) AS packets FROM pk GROUP BY ALL")
def text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows written as text lines and read back."""
    path = f"{scratch_dir(spark)}/flows"
    found = packets(spark, sf_dir).groupBy("src_ip", "src_port", "dst_ip", "dst_port").count()
    ip = lambda c: decode.long_to_ip(F.col(c))
    found.select(F.format_string("('%s', %d, '%s', %d): %d", ip("src_ip"), "src_port", ip("dst_ip"), "dst_port", "count")).write.text(path)
    return flow_text(spark, path).select("src_ip", "src_port", "dst_ip", "dst_port", "packets")


@registered(f"WITH {PK} SELECT src_ip, dst_ip, src_port, dst_port FROM pk")
def vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records written as packed binary files and read back."""
    path = f"{scratch_dir(spark)}/vectors"
    write_vector(packets(spark, sf_dir), path)
    return binary_vector(spark, f"{path}/*.vec", "flow4").select("src_ip", "dst_ip", "src_port", "dst_port")


@registered(
    f"WITH {LK}, h AS (SELECT src_ip, dst_ip, src_port, dst_port, segment FROM sg WHERE is_head = 1 AND (src_ip = 167772165 OR dst_port = 443)) SELECT ts_us, src_ip, dst_ip, src_port, dst_port, tcp_flags "
    f"FROM sg SEMI JOIN h USING (src_ip, dst_ip, src_port, dst_port, segment) WHERE ts_us BETWEEN (SELECT min(ts_us) FROM pk) + 86400000000 AND (SELECT min(ts_us) FROM pk) + 864000000000"
)
def query_to_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression and a time range to a capture file of whole flows, read back."""
    path, rows = f"{scratch_dir(spark)}/answer", packets(spark, sf_dir)
    first = rows.agg(F.min("ts_us")).first()[0] or 0
    at = lambda us: f"{us // 1_000_000}.{us % 1_000_000:06d}"
    query.to_capture(pcap.payload_of(linked_packets(spark, sf_dir)), path, "srcip == 10.0.0.5 || dstport == 443", at(first + 86400000000), at(first + 864000000000))
    return pcap.decoded(pcap.read_pcap(spark, f"{path}/*.pcap")).select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags")


@registered(f"WITH {PK} SELECT dst_port AS key, count(*) AS n FROM pk GROUP BY 1")
def stream_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files as a stream, decoded, and flushed as index files by micro-batch."""
    path = scratch_dir(spark)
    pcap.write_pcap(pcap.payload_of(packets(spark, sf_dir)), f"{path}/capture")
    stream = pcap.decoded(pcap.read_pcap(spark, f"{path}/capture/*.pcap", stream=True)).withColumn("rx_id", F.lit(0))
    linking.index_stream(stream, f"{path}/index", f"{path}/checkpoint", ["dst_port", "src_ip"], 4).awaitTermination()
    return spark.read.parquet(f"{path}/index/dst_port").groupBy("key").agg(F.count("*").alias("n"))


@registered(f"WITH {LK} SELECT src_port AS key, rx_id, off FROM sg WHERE is_head = 1 AND src_port >= 1025 AND src_port < 1028")
def index_file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open range looked up in written index files."""
    path = f"{scratch_dir(spark)}/index"
    index.write(index.compact(index.postings(flows.heads(linked_packets(spark, sf_dir)), 2)), path, 4, bloom=False)
    return index.half_open(spark.read.parquet(path), 1025, 1028)


@registered(f"WITH {PK} SELECT seq, z >> 20 AS top, z & 1048575 AS rest FROM (SELECT seq, CAST(({' + '.join(f'(((src_port >> {k}) & 1) << {2 * k}) + (((dst_port >> {k}) & 1) << {2 * k + 1})' for k in range(16))}) AS BIGINT) AS z FROM pk)")
def zorder_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading three digits of z and what is left below them."""
    z = zorder.interleave(F.col("src_port"), F.col("dst_port"))
    return packets(spark, sf_dir).select("seq", zorder.prefix(z, 3).alias("top"), zorder.suffix(z, 3).alias("rest"))
