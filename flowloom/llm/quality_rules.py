"""Quality rules whose thresholds follow the data.

Each document gets counts (words, symbols, repeated lines, repeated windows of words ...). For every (lang, source)
the values of each rule go to a log-linear histogram: a quantile sketch with a relative error of 1/16, whose merge is
addition, so partial sketches combine in any order and re-runs agree. Every fence is read from such a sketch; no rule has
a cutoff of its own:

- Where the median is above 0, the trait is common: the fence lies three times the distance from the median to the 90th
  percentile (at least one bucket, the sketch's own error) above the latter. Distances are in buckets, so they are ratios.
- Where the median is 0, the trait is rare: the tail of the sketch counts as clean as far as it goes on without a break, and
  a break is a stretch of more than 32 empty buckets (two octaves). The fence lies in the middle of the first break, or at
  the sketch's end if there is none.

Pairs with few documents use their language's sketch (the sum over its sources), languages with few documents the sum of
all. A source's fence is at most 16 buckets (one octave) above its language's, so a source of nothing but junk doesn't set
its own law. Documents then join their pair's fences and are filtered.

Edge cases: null text counts as empty and fails the base rule; null lang or source count as ''; repeated rows and tied
values are judged alike; an empty table gives an empty table; further input columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import BLANK_CHARS, fresh, let, store, words

RULES = ("symbol_rate", "upper_rate", "shout_rate", "dup_line_rate", "repeat_rate", "word_length")
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_DOCS = 10, 20, 200
#: Of every rule alike, in buckets of the sketch: empty ones that break a tail, multiples of the distance to the 90th percentile, and how far a source may go beyond its language.
BREAK, REACH, BEYOND = 32, 3, 16


def _covered(hashes: Column) -> Column:
    """Words that lie in a 5-word window whose hash occurs twice or more, from the hash of each window."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(ordered, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
    gaps = let(F.array_sort(twice), lambda p: F.transform(p, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - i, F.lit(5)))))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def _repeats(text: Column) -> Column:
    """struct(n_words, n_repeat_words). Windows compare as 64-bit hashes of word hashes within one text; sorting is only for texts that repeat."""

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))
        repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) < 6, 0).otherwise(repeated).cast("long").alias("n_repeat_words"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), count)


def measures(text: Column) -> Column:
    """The counts of a text as one struct; all of it runs inside the JVM."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return let(
        F.struct(_repeats(text).alias("r"), lines.alias("lines")),
        lambda x: F.struct(
            x["r"]["n_words"].alias("n_words"),
            F.length(F.translate(t, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").cast("long").alias("n_symbols"),
            F.size(x["lines"]).cast("long").alias("n_lines"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
            x["r"]["n_repeat_words"].alias("n_repeat_words"),
            without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
            without("!?~=_^").cast("long").alias("n_shouts"),
        ),
    )


def _rates(m: Column) -> dict[str, Column]:
    """The rules' values: whole numbers of at least 0."""
    rate = lambda n, of: F.floor(1000 * m[n] / F.greatest(m[of], F.lit(1))).cast("long")
    return {"symbol_rate": rate("n_symbols", "n_words"), "upper_rate": rate("n_upper", "word_chars"), "shout_rate": rate("n_shouts", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"), "word_length": rate("word_chars", "n_words")}


def _bucket(v: Column) -> Column:
    """Log-linear bucket: values under 32 stand alone, larger ones keep their five leading bits."""
    e = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return 16 * e + F.call_function("shiftright", v, e)


def _top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.greatest(F.floor(b / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - 16 * e + 1, e) - 1


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and fence (a bucket) by keys and rule, from counts by bucket. A window holds one key's buckets, at most about 1,000."""
    w = Window.partitionBy(*keys, "rule")
    ranked = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w), "after": F.lead("bucket").over(w.orderBy("bucket"))})
    level = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bucket")))
    broken = F.min(F.when(F.col("after") - F.col("bucket") > BREAK, F.floor((F.col("bucket") + F.col("after")) / 2)))
    q = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("docs"), level(5).alias("q50"), level(9).alias("q90"), broken.alias("broken"), F.max("bucket").alias("end"))
    common = F.col("q90") + REACH * F.greatest(F.col("q90") - F.col("q50"), F.lit(1))
    return q.select(*keys, "rule", "docs", F.when(F.col("q50") > 0, common).otherwise(F.coalesce("broken", "end")).alias("fence"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source and a fence for each rule, from the sketches of all pairs."""
    merge = lambda keys: _fences(sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n")), keys)
    pair = _fences(sketch, ["lang", "source"])
    lang = merge(["lang"]).select("lang", "rule", F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence"))
    every = merge([]).select("rule", F.col("fence").alias("all_fence"))
    own = F.when(F.col("lang_docs") < min_docs, F.col("all_fence")).otherwise(F.col("lang_fence"))
    joined = pair.join(lang, ["lang", "rule"]).join(F.broadcast(every), "rule").withColumn("own", own)  # every: one row a rule
    fence = _top(F.when(F.col("docs") < min_docs, F.col("own")).otherwise(F.least(F.col("fence"), F.col("own") + BEYOND)))
    return joined.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == k, fence)).alias(k) for k in RULES))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, min_docs: int = MIN_DOCS) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and a struct of counts, base_failed and kept; returns it and the struct's name.

    The carried columns and counts are written once into the shared folder, so texts are read and measured once."""
    carry = docs.columns if carry is None else carry
    (verdict, l, s) = fresh(docs, "verdict", "lang_key", "source_key")
    measured = docs.select(*(docs[c] for c in carry), measures(docs[text]).alias(verdict), F.coalesce(docs[lang], F.lit("")).alias(l), F.coalesce(docs[source], F.lit("")).alias(s))
    measured = store(measured, "measures")
    m = F.col(verdict)
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    points = measured.where(~base).select(F.col(l).alias("lang"), F.col(s).alias("source"), F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), _bucket(v).alias("bucket")) for k, v in _rates(m).items()))).alias("p"))
    sketch = store(points.groupBy("lang", "source", "p.rule", "p.bucket").agg(F.count("*").alias("n")), "sketch")
    fences = store(thresholds(sketch, min_docs), "fences")  # a few rows: with its size known, Spark broadcasts it only while it is small
    fences = fences.select(F.col("lang").alias(l), F.col("source").alias(s), F.struct(*RULES).alias(f"{verdict}_fence"))
    passed = F.lit(True)
    for k, v in _rates(m).items():
        passed = passed & (v <= F.col(f"{verdict}_fence")[k])
    joined = measured.join(fences, [l, s], "left")
    full = F.struct(*(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), F.when(base, False).otherwise(passed).alias("kept"))
    return joined.select(*(F.col(f"`{c}`") for c in carry), full.alias(verdict)), verdict


def quality_filter(docs: DataFrame, **columns) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    judged, verdict = judge(docs, **columns)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)
