"""Registered queries of the operators that SQL can express, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import exact_dedup, mixing, quality_rules
from flowloom.llm.common import table


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, m = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", *(F.col(f"{m}.{c}") for c in ("size", "source_size", "target", "taken")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, v = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", f"{v}.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, v = exact_dedup.group_copies(table(spark, sf_dir, "documents"), carry=["doc_id"], stays="largest")
    return grouped.select("doc_id", f"{v}.*")


WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mixing_cte(documents: str, p: str = "") -> str:
    """Common table expressions ending in {p}mixed(doc_id, size, source_size, target, copies, taken, text, lang, source, n_chars)."""
    return f"""
{p}hashed AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '0' ELSE '1' || doc_id::VARCHAR END || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h0 FROM {documents}),
{p}sized AS (SELECT *, (CASE WHEN r = 0 THEN h0 ELSE ('0x' || substr(md5(h0::VARCHAR || ':' || r::VARCHAR), 1, 15))::BIGINT END) >> 20 AS h
    FROM (SELECT *, row_number() OVER (PARTITION BY source, h0) - 1 AS r FROM {p}hashed)),
{p}src AS (SELECT source, sum(size)::HUGEINT AS s FROM {p}sized GROUP BY source),
{p}wt AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w, 3 * s AS cap FROM {p}src),
{p}run AS (SELECT *, sum(s) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {p}wt),
{p}capd AS (SELECT *, (total - caps) * w >= cap * rest AS capped FROM {p}run),
{p}goal AS (SELECT source, s, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w)::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM {p}capd),
{p}budget AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s::DOUBLE)::BIGINT ELSE 0 END AS fully,
    CASE WHEN s > 0 THEN target - floor(target / s::DOUBLE) * s::DOUBLE ELSE 0 END AS rem FROM {p}goal),
{p}part AS (SELECT source, h, sum(size) AS n FROM {p}sized GROUP BY source, h),
{p}upto AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM {p}part),
{p}edge AS (SELECT u.source, min(h) AS h FROM {p}upto u JOIN {p}budget b ON u.source IS NOT DISTINCT FROM b.source WHERE u.upto::DOUBLE > b.rem GROUP BY u.source),
{p}cut AS (SELECT e.source, e.h + CASE WHEN 2 * (b.rem - (u.upto - u.n)::DOUBLE) >= u.n::DOUBLE THEN 1 ELSE 0 END AS cut
    FROM {p}edge e JOIN {p}upto u ON u.source IS NOT DISTINCT FROM e.source AND u.h = e.h JOIN {p}budget b ON b.source IS NOT DISTINCT FROM e.source),
{p}mixed AS (SELECT d.*, b.s::BIGINT AS source_size, b.target AS target,
    b.fully + CASE WHEN d.h < coalesce(c.cut, 0) THEN 1 ELSE 0 END AS copies,
    (d.size * (b.fully + CASE WHEN d.h < coalesce(c.cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM {p}sized d JOIN {p}budget b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN {p}cut c ON d.source IS NOT DISTINCT FROM c.source)"""


def rules_cte(documents: str) -> str:
    """Common table expressions ending in judged: documents' columns, the counts, base_failed and kept. documents needs doc_id to be unique."""
    chars = lambda c: f"(length(t) - length(translate(t, '{c}', '')))::BIGINT"
    rates = {"symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "upper_rate": "1000 * n_upper // greatest(word_chars, 1)", "shout_rate": "1000 * n_shouts // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "1000 * word_chars // greatest(n_words, 1)"}
    points = " UNION ALL ".join(f"SELECT l, s, '{k}' AS rule, {v} AS v FROM counted WHERE NOT base_failed" for k, v in rates.items())
    top = lambda b: f"((({b} - 16 * greatest({b} // 16 - 1, 0) + 1) << greatest({b} // 16 - 1, 0)) - 1)"

    def fences(name: str, keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        return f"""{name}_q AS (SELECT {comma}rule, max(total) AS docs, min(CASE WHEN 10 * upto >= 5 * total THEN bucket END) AS q50, min(CASE WHEN 10 * upto >= 9 * total THEN bucket END) AS q90,
        min(CASE WHEN after - bucket > 32 THEN (bucket + after) // 2 END) AS broken, max(bucket) AS tail
    FROM (SELECT {comma}rule, bucket, sum(n) OVER (PARTITION BY {comma}rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {comma}rule) AS total, lead(bucket) OVER (PARTITION BY {comma}rule ORDER BY bucket) AS after
        FROM (SELECT {comma}rule, bucket, sum(n) AS n FROM sketch GROUP BY {comma}rule, bucket)) GROUP BY {comma}rule),
{name} AS (SELECT {comma}rule, docs, CASE WHEN q50 > 0 THEN q90 + 3 * greatest(q90 - q50, 1) ELSE coalesce(broken, tail) END AS fence FROM {name}_q)"""

    passed = " AND ".join(f"{v} <= f.{k}" for k, v in rates.items())
    return rf"""
raw AS (SELECT *, coalesce(text, '') AS t, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM {documents}),
split AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM raw),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
win AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, g FROM win WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, g), (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
meas AS (SELECT split.*, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    {chars("#*$%&|<>")} AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    {chars(UPPER)} AS n_upper, {chars("!?~=_^")} AS n_shouts FROM split LEFT JOIN cover USING (doc_id)),
counted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM meas),
points AS ({points}),
sketch AS (SELECT l, s, rule, 16 * greatest(length(bin(v)) - 5, 0) + (v >> greatest(length(bin(v)) - 5, 0)) AS bucket, count(*) AS n FROM points GROUP BY ALL),
{fences("pairf", "l, s")},
{fences("langf", "l")},
{fences("allf", "")},
own AS (SELECT p.l, p.s, rule, p.docs, p.fence, CASE WHEN g.docs < 200 THEN a.fence ELSE g.fence END AS own FROM pairf p JOIN langf g USING (l, rule) JOIN allf a USING (rule)),
chosen AS (SELECT l, s, rule, {top("(CASE WHEN docs < 200 THEN own ELSE least(fence, own + 16) END)")} AS fence FROM own),
fence AS (SELECT l, s, {", ".join(f"max(CASE WHEN rule = '{k}' THEN fence END) AS {k}" for k in rates)} FROM chosen GROUP BY l, s),
judged AS (SELECT c.*, CASE WHEN base_failed THEN false ELSE {passed} END AS kept FROM counted c LEFT JOIN fence f USING (l, s))"""


def copies_sql(documents: str, order: str) -> str:
    return f"SELECT doc_id, {order}(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = {order}(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM {documents})"


QUERIES = {"op5_mixing": op5_mixing, "op7_quality_rules": op7_quality_rules, "op9_exact_dedup": op9_exact_dedup}
ORACLES = {
    "op5_mixing": f"WITH {mixing_cte('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed",
    "op7_quality_rules": f"WITH {rules_cte('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
    "op9_exact_dedup": copies_sql("documents", "max"),
}
