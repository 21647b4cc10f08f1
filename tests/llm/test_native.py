"""Quality rules, exact dedup and mixing against SQL, with odd rows; sharding against its laws."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import exact_dedup, mixing, quality_rules, sharding
from flowloom.llm.queries import op8_sharding
from flowloom.llm.queries_native import ORACLES, QUERIES, copies_sql
from tests.llm.test_bulk import ODD, SCHEMA
from tests.oracle import assert_same

LINE = "one two three four five six seven eight nine ten eleven"
TEXTS = [*ODD, LINE, LINE.upper(), f"{LINE}\n{LINE}\nother words stand in this line too\n{LINE}", "ab ab ab ab ab ab ab ab ab ab", "É é É", "#x *y $z %a &b |c <d >e f g h i", " ".join(f"w{i % 7}" for i in range(200))]


def odd(spark, path, texts=TEXTS, copies=1):
    rows = [(i + 1000 * c, t, (None, "en", "de")[i % 3], (None, "b", "a", "é", "B")[i % 5], 0) for c in range(copies) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["sf", "odd", "copies", "empty"])
def test_query_equals_sql(spark, sf, tmp_path, name, kind):
    path = sf if kind == "sf" else odd(spark, tmp_path, [] if kind == "empty" else TEXTS, 3 if kind == "copies" else 1)
    assert_same(QUERIES[name](spark, path), ORACLES[name], {"documents": f"{path}/documents.parquet" + ("" if kind == "sf" else "/*.parquet")})


def test_thresholds_follow_the_data(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 991}" for k in range(80)), "en", f"s{i % 2}") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{k}###" for k in range(60)), "en", "s0") for i in range(20)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    assert sorted(r[0] for r in quality_rules.quality_filter(docs).select("doc_id").collect()) == list(range(200))


def test_every_fence_follows_language_and_source(spark):
    """On the corpus itself: fences of one rule differ between pairs, and a shift of one pair's values shifts its fence alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = docs.select(quality_rules.measures(F.col("text")).alias("m"), "lang", "source")
    rates = F.array(*(F.struct(F.lit(k).alias("rule"), quality_rules._bucket(v).alias("bucket")) for k, v in quality_rules._rates(F.col("m")).items()))
    sketch = m.where("m.n_words >= 10").select("lang", "source", F.explode(rates).alias("p")).groupBy("lang", "source", "p.rule", "p.bucket").agg(F.count("*").alias("n")).cache()
    fences = quality_rules.thresholds(sketch, 50).toPandas()
    assert len(fences) == 80 and all(fences[k].nunique() > 1 for k in quality_rules.RULES)
    one = fences.iloc[0]
    moved = sketch.withColumn("bucket", F.when((F.col("lang") == one["lang"]) & (F.col("source") == one["source"]) & (F.col("rule") == "word_length"), F.col("bucket") + 5).otherwise(F.col("bucket")))
    again = quality_rules.thresholds(moved, 50).toPandas().merge(fences, on=["lang", "source"])
    here = (again["lang"] == one["lang"]) & (again["source"] == one["source"])
    assert (again.loc[here, "word_length_x"] > again.loc[here, "word_length_y"]).all()
    assert (again.loc[again["lang"] != one["lang"], "word_length_x"] == again.loc[again["lang"] != one["lang"], "word_length_y"]).all()
    sketch.unpersist()


def test_thresholds_leave_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"))
    kept = QUERIES["op7_quality_rules"](spark, sf).where("NOT base_failed").join(labels, "doc_id").groupBy("q").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    share = {r["q"]: r["kept"] for r in kept.collect()}
    assert share[1] > 0.985 and share[0] < 0.05


def test_clashing_names_pass_through(spark):
    names = "doc_id long, text string, lang string, source string, verdict string, copies int, mixed string, place int, n_words int, size int, h string, key string, row int, n int"
    rows = [(1, LINE, "en", "a", "v", 1, "m", 2, 3, 4, "h", "k", 5, 6), (1, LINE, "en", "a", "v", 1, "m", 2, 3, 4, "h", "k", 5, 6), (2, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names)
    assert [tuple(r) for r in exact_dedup.drop_copies(docs).orderBy("doc_id").collect()] == [rows[0], rows[2]]
    assert [tuple(r) for r in quality_rules.quality_filter(docs).collect()] == rows[:2]
    assert {tuple(r) for r in mixing.mixture(docs).collect()} == {rows[0]}
    placed, p = sharding.assign(docs, 4)
    assert sorted(map(str, placed.drop(p).collect())) == sorted(map(str, docs.collect()))


def test_collisions_are_told_apart(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "A", "c", "b", "", None, "aa", "d" * 9])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    got, v = exact_dedup.group_copies(docs, stays="smallest", carry=["doc_id"], hashed=lambda t: F.substring(F.unhex(F.md5(t.cast("binary"))), 1, 0))
    assert_same(got.select("doc_id", f"{v}.*"), copies_sql("documents", "min"), {"documents": f"{tmp_path}/d/*.parquet"})


def test_mix_meets_targets_and_nests(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(n)), "abc"[i % 2 + i % 7 // 6]) for i, n in enumerate(rng.integers(1, 40, 3000))], "doc_id long, text string, source string")
    rows = mixing.mix(docs, carry=["doc_id", "source"])[0].select("doc_id", "source", "mixed.*").collect()
    for source in "abc":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40 and all(r["taken"] <= 3 * r["size"] for r in own)
    more = {r["doc_id"]: r["mixed"]["copies"] for r in mixing.mix(docs, carry=["doc_id"], weights=(1, 1, 5))[0].collect()}
    assert all(more[r["doc_id"]] >= r["copies"] for r in rows if r["source"] == "c")
    assert mixing.mixture(docs).count() == sum(r["copies"] for r in rows)


@pytest.mark.parametrize("text", ["w w w", None])
def test_mix_of_repeated_and_null_ids(spark, tmp_path, text):
    """Nine of ten rows of a source share their id, and with it their text or not."""
    rows = [(None if i % 10 else i, text or f"w{i} w w", "en", "a" if i % 3 else "b", 0) for i in range(900)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for carry in (["doc_id", "source"], ["doc_id", "source", "text"]):
        got = mixing.mix(docs, carry=carry)[0].groupBy("source").agg(F.sum("mixed.taken").alias("taken"), F.max("mixed.target").alias("target"), F.count("*").alias("n")).collect()
        assert sum(r["n"] for r in got) == 900 and all(abs(r["taken"] - r["target"]) <= 3 for r in got)
    assert_same(QUERIES["op5_mixing"](spark, str(tmp_path)), ORACLES["op5_mixing"], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


@pytest.mark.parametrize("kind", ["sf", "odd", "empty"])
def test_shards_keep_their_law(spark, sf, tmp_path, kind):
    path = sf if kind == "sf" else odd(spark, tmp_path, [] if kind == "empty" else TEXTS * 3)
    rows, texts = op8_sharding(spark, path).collect(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["grown_shard"] in (r["shard"], 16)
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_written_shards_and_growth(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5
    moved = sharding.grow(docs, "", 5)
    assert 0 < moved.count() < docs.count() / 2 and set(moved.columns) == set(docs.columns)
