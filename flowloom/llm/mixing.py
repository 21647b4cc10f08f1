"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash of its id and text, and of its running number among rows of its source with equal id and
text, if there are such. A source whose target is t of its s words gives all documents t div s times,
and the remainder comes from the documents whose hash lies under a threshold. The threshold is found without sorting: sum
words by source and the hash's ten leading bits, find the bucket in which the running sum passes the budget, then sum only
that bucket by the next ten bits, and so on for four levels (40 bits: a boundary bucket of 10^11 documents holds none or
one). Thresholds nest: a larger budget keeps what a smaller one took, and re-runs agree.

Targets: sources in code-point order, null last, have weights 1, 2, 3, repeating (or those given) and share all words;
none exceeds `most` times its source's words, and the excess goes to the others by weight until none is above.

Edge cases: null text has size 0; a null source is a source of its own, after all others; documents of size 0 are taken
0 words; a source without words has target 0 and its documents are left out; rows equal in source, id and text are decided
one by one, so a source of nothing but copies meets its target too (docs are then written once more); an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, store, words

BITS, LEVELS, HASH_BITS, MOST = 10, 4, 60, 3


def _sixty(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_hash(id: Column, text: Column) -> Column:
    """60 bits of an id and a text; a null id differs from every other."""
    own = id.cast("string")
    return _sixty(F.concat(F.when(own.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), own)), F.lit("/"), F.coalesce(text, F.lit(""))))


def _numbered(rows: DataFrame, twice: DataFrame, m: str) -> DataFrame:
    """rows with the hash of their running number in it, where their key and hash occur twice or more.

    rows: key, {m} (a struct with the hash), row (increasing within a partition, whose number is in the upper bits)."""
    (n, own, before) = fresh(rows, "n", "own_place", "before")
    marked = rows.join(twice.toDF(f"{m}_k", f"{m}_h", n), (F.col("key") == F.col(f"{m}_k")) & (F.col(m)["hash"] == F.col(f"{m}_h")), "left").drop(f"{m}_k", f"{m}_h")
    again = marked.where(F.col(n).isNotNull()).withColumn("pid", F.shiftright("row", 33)).withColumn(f"{m}_h", F.col(m)["hash"])
    counts = again.groupBy("key", f"{m}_h", "pid").agg(F.count("*").alias(own))  # a row a key, hash and partition
    base = F.coalesce(F.sum(own).over(Window.partitionBy("key", f"{m}_h").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("key", f"{m}_h", "pid", base.alias(before))
    place = F.row_number().over(Window.partitionBy("key", f"{m}_h", "pid").orderBy("row")) - 1
    placed = again.withColumn(own, place).join(bases, ["key", f"{m}_h", "pid"]).withColumn(own, F.col(own) + F.col(before))
    hashed = F.when(F.col(own) == 0, F.col(m)["hash"]).otherwise(_sixty(F.concat_ws(":", F.col(m)["hash"], F.col(own))))
    renewed = placed.withColumn(m, F.col(m).withField("hash", hashed)).select(*rows.columns)
    return marked.where(F.col(n).isNull()).select(*rows.columns).union(renewed)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, size, target. sources: one row each, so ranking them in one task stays small (a row a source, not a row a document)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(w).cast("decimal(38,0)") for w in weights))
    w = sources.withColumn("weight", cycle[rank % len(weights)]).withColumn("cap", (most * F.col("size")).cast("decimal(38,0)"))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    dec = lambda c: c.cast("decimal(38,0)")
    zero = dec(F.lit(0))
    run = w.withColumns({
        "total": dec(F.sum(F.col("size")).over(Window.partitionBy())),
        "caps": F.coalesce(dec(F.sum("cap").over(below)), zero),
        "rest": dec(F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))),
    })
    run = run.withColumn("capped", dec((F.col("total") - F.col("caps")) * F.col("weight")) >= dec(F.col("cap") * F.col("rest")))
    over = Window.partitionBy()
    run = run.withColumns({"c": dec(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(over), zero)), "w": dec(F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(over), zero))})
    share = dec((F.col("total") - F.col("c")) * F.col("weight")).cast("double") / F.col("w").cast("double")
    return run.select("source", "size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _key(source: Column) -> Column:
    """A join key that is never null and keeps null apart from all texts."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def plan(light: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """key, source_size, target, full, cut: documents of a source are taken full times, and once more if hash >> 20 < cut.

    light: key, source, size, hash for each document."""
    sums = light.groupBy("key", "source").agg(F.sum("size").cast("long").alias("size"))
    goal = store(targets(sums, weights, most), "targets")
    full = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    at = goal.select(_key(F.col("source")).alias("key"), F.col("size").alias("source_size"), "target", full.alias("full"), F.when(F.col("size") > 0, F.col("target") - full * F.col("size")).otherwise(F.lit(0.0)).alias("left"), F.lit(0).cast("long").alias("prefix"))
    at = store(at, "budgets")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        inside = light.select("key", "size", F.shiftright("hash", shift + BITS).alias("prefix"), F.shiftright("hash", shift).alias("part"))
        parts = inside.join(at.select("key", "prefix"), ["key", "prefix"], "left_semi").groupBy("key", "part").agg(F.sum("size").alias("n"))
        upto = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("part")))  # at most 1,024 rows a key
        found = upto.join(at.select("key", "left"), "key").where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min(F.struct("part", "upto", "n")).alias("at"))
        step = at.join(found, "key", "left")
        a = F.col("at")
        spent = F.col("left") - (a["upto"] - a["n"])
        if level < LEVELS:
            at = store(step.select("key", "source_size", "target", "full", F.coalesce(spent, F.lit(0.0)).alias("left"), F.coalesce(a["part"], F.lit(-1).cast("long")).alias("prefix")), "budgets")
        else:
            cut = F.when(a.isNull(), 0).otherwise(a["part"] + (2 * spent >= a["n"]).cast("long"))
            at = step.select("key", "source_size", "target", "full", cut.cast("long").alias("cut"))
    return store(at, "cuts")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and a struct (size, source_size, target, copies, taken); returns it and the struct's name."""
    carry = docs.columns if carry is None else carry
    (mixed,) = fresh(docs, "mixed")
    # the carried columns travel in a struct, so they clash with nothing
    own = F.struct(F.lit(0).alias("_"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry))).alias("own")
    m = F.struct(F.size(words(docs[text])).cast("long").alias("size"), row_hash(docs[id], docs[text]).alias("hash")).alias("m")
    whole = docs.select(_key(docs[source]).alias("key"), docs[source].alias("source"), m, F.monotonically_increasing_id().alias("row"), own)
    light = store(whole.drop("own") if text in carry else whole, "sizes")
    twice = store(light.groupBy("key", F.col("m.hash").alias("hash")).agg(F.count("*").alias("n")).where("n > 1"), "twice")
    rows = whole if text in carry else light
    if not twice.isEmpty():
        rows = light = store(_numbered(store(whole, "whole") if text in carry else light, twice, "m"), "numbered")
    cuts = plan(light.select("key", "source", "m.size", "m.hash"), weights, most)
    cuts = cuts.select("key", F.struct("source_size", "target", "full", "cut").alias("c"))
    joined, m, c = rows.join(cuts, "key", "left"), F.col("m"), F.col("c")
    copies = c["full"] + (F.shiftright(m["hash"], HASH_BITS - BITS * LEVELS) < c["cut"]).cast("long")
    out = F.struct(m["size"].alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), copies.alias("copies"), (m["size"] * copies).alias("taken"))
    return joined.select(*(F.col("own")[f"c{i}"].alias(x) for i, x in enumerate(carry)), out.alias(mixed)), mixed


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with its columns as they were."""
    mixed, name = mix(docs, **options)
    (again,) = fresh(mixed, "again")
    return mixed.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(name)["copies"].cast("int")))).drop(name, again)
