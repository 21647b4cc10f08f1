"""Exact duplicates by a 128-bit content hash, with bytes compared inside the groups.

1. Every row leaves its id and the MD5 of its normalised text; groups are counted from these light rows, with partial
   sums before the shuffle, so a group of any size costs a row a task.
2. Texts whose hash occurs once are left out where they are read, while Spark measures the table of the other hashes as
   small; beyond that, by a join whose hot hashes Spark splits. The rest meet under (hash, salt); the least and the greatest
   text of each are kept, with partial results before the shuffle. Equal bytes mean equal extremes; a hash whose extremes differ has collided.
3. Rows with a collided hash are grouped again by hash and whole text. Without collisions this step never runs.
4. Light rows join their group's verdict; Spark splits a skewed hash among tasks.

Edge cases: null text counts as empty; a null id sorts below all ids; rows equal in text and id tie, and the one that comes
first in the input's files stays; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ascii_lower, fresh, store

SALTS = 64


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def collisions(docs: DataFrame, groups: DataFrame, text: str, hashed, salts: int = SALTS) -> DataFrame:
    """Hashes shared by different texts, found by comparing the bytes of all texts whose hash occurs twice or more."""
    norm = normalised(docs[text])
    full = docs.select(hashed(norm).alias("h"), norm.alias("t")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    many = store(groups.where("n > 1").select("h").distinct(), "many")  # of known size: small, it goes to the texts, and unique ones never leave their task
    met = full.join(many, "h", "left_semi")
    ends = met.groupBy("h", "salt").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return store(ends.where("lo <> hi").select("h"), "collided")


def group_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, stays: str = "smallest", hashed=content_hash) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and a struct (keep_id, group_size, kept, text_sha256); returns it and the struct's name.

    stays: "smallest" or "largest" id of each group of equal texts. hashed: binary hash of a text column."""
    carry = docs.columns if carry is None else carry
    (verdict,) = fresh(docs, "copies")

    def keyed(collided: DataFrame | None) -> DataFrame:
        norm = normalised(docs[text])
        rows = docs.select(*(docs[c] for c in carry), F.struct(hashed(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("sha"), docs[id].alias("id"), F.monotonically_increasing_id().alias("row"), (F.lit("") if collided is None else norm).alias("t")).alias(verdict))
        if collided is None:
            return store(rows, "keys")
        (h,) = fresh(rows, "collided")
        marked = rows.join(collided.select(F.col("h").alias(h)), F.col(verdict)["h"] == F.col(h), "left")
        return store(marked.withColumn(verdict, F.col(verdict).withField("t", F.when(F.col(h).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(verdict)["t"])))).drop(h), "keys")

    def grouped(rows: DataFrame) -> DataFrame:
        best = F.max(F.struct("id", -F.col("row"))) if stays == "largest" else F.min(F.struct(F.col("id"), F.col("row")))
        return store(rows.select(f"{verdict}.*").groupBy("h", "t").agg(F.count("*").alias("n"), best.alias("best")), "groups")

    rows = keyed(None)
    groups = grouped(rows)
    collided = collisions(docs, groups, text, hashed)
    if not collided.isEmpty():
        rows = keyed(collided)
        groups = grouped(rows)
    (h, t, n, best) = fresh(rows, "group_h", "group_t", "group_n", "group_best")
    named = groups.toDF(h, t, n, best)
    v, b = F.col(verdict), F.col(best)
    joined = rows.join(named, (v["h"] == F.col(h)) & (v["t"] == F.col(t)), "left")
    row = -b["col2"] if stays == "largest" else b["row"]
    out = F.struct(b["id"].alias("keep_id"), F.col(n).alias("group_size"), (v["row"] == row).alias("kept"), v["sha"].alias("text_sha256"))
    return joined.select(*(F.col(f"`{c}`") for c in carry), out.alias(verdict)), verdict


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of equal texts, with its columns as they were."""
    grouped, verdict = group_copies(docs, **options)
    return grouped.where(F.col(verdict)["kept"]).drop(verdict)
