"""The filter language: trees, rejects, and random expressions against plain Python."""

import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.operators.query import select, time_range
from flowloom.plans.expr import Compare, FilterError, Join, Not, compile_filter, is_core, parse, tokens

COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "src_ip6", "dst_ip6", "caplen", "tcp_flags", "payload", "event_type", "tag_1"]


def test_connectives_fold_from_the_left():
    tree = parse("srcport == 1 || srcport == 2 && srcport == 3")
    assert isinstance(tree, Join) and tree.op == "&&" and tree.left.op == "||"
    tree = parse("srcport == 1 || (srcport == 2 && !srcport == 3)")
    assert tree.op == "||" and tree.right.op == "&&" and isinstance(tree.right.right, Not)


def test_core_and_extensions():
    assert is_core(parse("(srcip == 1.2.3.4/8 || dstport == 5)"))
    for text in ("!srcport == 1", "srcport > 1", "srcport in {1,2}", "tag.1 == 4", "payload[0:1] == 45", "srcport == 1 ^^ dstport == 2"):
        assert not is_core(parse(text))


def test_literals():
    kinds = lambda text: [t.kind for t in tokens(text)]
    assert kinds("srcip == ::1") == ["name", "symbol", "ip"]
    assert kinds("true false 0x1F 1.5 10.0.0.0/8 2001:db8::/32 aa:bb:cc:dd:ee:ff \"a b\" tag.3") == ["bool", "bool", "number", "number", "net", "net", "mac", "string", "name"]
    assert kinds("payload[1:3] == 4500")[:6] == ["name", "symbol", "number", "symbol", "number", "symbol"]


@pytest.mark.parametrize("text", [
    "", "(", "srcip", "srcip ==", "srcip == 1.2.3.4)", "(srcip == 1.2.3.4", "srcip == == 1.2.3.4", "nobody == 3", "srcip == 1.2.3.400", "srcip == 7", "srcport == 1.2.3.4",
    "srcport == \"a", "srcport in {}", "srcport in {1 2}", "srcport in {1,", "type[1] == \"a\"", "type[1:2 == \"a\"", "type[1:2:0] == \"a\"", "srcport[0:1] == 1", "tag.9 == 1",
    "srcport == 1 srcport == 2", "srcport == 1 &&", "&& srcport == 1", "srcip > 10.0.0.0/8", "srcport contains 1", "srcip in {1.2.3.4, ::1}", "srcport = 1", "srcport == 1 | srcport == 2", "{srcport == 1}",
])
def test_rejects(spark, text):
    with pytest.raises(FilterError):
        compile_filter(text, COLUMNS)


def table(spark):
    rows = [(167772160 + i, 3232235520 + i % 3, 1000 + i % 5, (80, 443)[i % 2], bytes([i, 16 - i, 7]), "ab" * (i % 3 + 1), i, ipaddress.IPv6Address(f"2001:db8::{i:x}").packed) for i in range(16)]
    return spark.createDataFrame(rows, "src_ip long, dst_ip long, src_port int, dst_port int, payload binary, event_type string, tag_1 long, src_ip6 binary")


@pytest.mark.parametrize("text,test", [
    ("srcip == 10.0.0.4/30", lambda i: 4 <= i < 8), ("srcip == 10.0.0.0/0", lambda i: True), ("srcip == 10.0.0.3/32", lambda i: i == 3), ("srcip != 10.0.0.4/30", lambda i: not 4 <= i < 8),
    ("tag.1 >= 5 ^^ dstport == 80", lambda i: (i >= 5) != (i % 2 == 0)), ("payload[0:1] == 0x05", lambda i: i == 5), ("payload[:2] == 0x0a06", lambda i: i == 10), ("payload[::2] == 0x0907", lambda i: i == 9),
    ("payload contains 0x0e0207", lambda i: i == 14), ("type[1:4] == \"bab\"", lambda i: i % 3 >= 1), ("srcip in {10.0.0.1, 10.0.0.8/31}", lambda i: i in (1, 8, 9)), ("srcip == 2001:db8::a", lambda i: i == 10), ("srcip == 2001:db8::/125", lambda i: i < 8),
])
def test_meaning(spark, text, test):
    assert sorted(r[0] for r in select(table(spark), text).select("tag_1").collect()) == [i for i in range(16) if test(i)]


ATOMS = st.sampled_from([("srcport == 1002", lambda i: i % 5 == 2), ("dstport == 443", lambda i: i % 2 == 1), ("srcip == 10.0.0.0/29", lambda i: i < 8), ("dstip == 192.168.0.1", lambda i: i % 3 == 1), ("tag.1 < 6", lambda i: i < 6)])
JOINS = {"&&": lambda a, b: a and b, "||": lambda a, b: a or b, "^^": lambda a, b: a != b}


@st.composite
def expressions(draw, depth=2):
    text, test = draw(ATOMS) if depth == 0 else draw(expressions(depth=depth - 1))
    for op in draw(st.lists(st.sampled_from(sorted(JOINS)), max_size=2)):
        more, other = draw(ATOMS) if depth == 0 else draw(expressions(depth=depth - 1))
        more = f"({more})" if depth else more
        if draw(st.booleans()):
            more, other = f"!{more}", lambda i, o=other: not o(i)
        text, test = f"{text} {op} {more}", lambda i, a=test, b=other, f=JOINS[op]: f(a(i), b(i))
    return text, test


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(expressions())
def test_random_expressions(spark, found):
    text, test = found
    rows = table(spark)
    assert sorted(r[0] for r in rows.where(compile_filter(text, rows.columns)).select("tag_1").collect()) == [i for i in range(16) if test(i)]


def test_times_include_both_ends(spark):
    rows = spark.createDataFrame([(1_500_000,), (2_000_000,), (2_000_001,)], "ts_us long")
    at = lambda a, b: [r[0] for r in rows.where(time_range(a, b)).collect()]
    assert at("1.5", "2") == [1_500_000, 2_000_000] and at("", "") == at(None, None) and len(at("2.000001", None)) == 1


def test_filters_reach_the_scan(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("src_ip"), F.lit(1).alias("dst_ip"), F.col("user_id").cast("int").alias("src_port"), F.lit(2).alias("dst_port"), F.col("event_id").alias("ts_us"))
    rows.write.parquet(f"{tmp_path}/p")
    plan = select(spark.read.parquet(f"{tmp_path}/p"), "srcip == 0.0.0.5 && srcport == 5").select("ts_us")._jdf.queryExecution().toString()
    assert "EqualTo(src_ip,5)" in plan and "EqualTo(src_port,5)" in plan
