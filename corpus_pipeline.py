"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. A stage works
on all that its predecessor kept. The mix gives a document's row as often as it is taken; the last stage turns every text
into ids, which SQL can't, so there is no SQL for the whole.

A stage's rows are made when they are written, from tables that its operator has stored. Once the next stage is called on
rows that have been written and read again, it removes those tables; a stage called on another's own rows leaves them.

Edge cases, in every stage: a null or empty text fails the quality rules, so only stages called alone meet one, and keep
it: exact dedup as a copy of the empty text, near dedup as linked with nothing, mixing as a row of no words (not taken),
encoding as a row without ids. Null ids, languages and sources are values of their own; rows equal in all columns are
copies of one another; an empty table gives an empty table; further columns pass through all stages but the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import exact_dedup, minhash_dedup, mixing, piece_lattice, quality_rules
from flowloom.llm.common import drop, reads, remove, small_batches, store, stored_inside, table
from flowloom.llm.queries import tokenizer_file

#: Similarity from which the mix counts documents as near duplicates; op6 has its own, 85.
NEAR_PERCENT = 80
_left: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """The stage, with small Arrow batches, removing first what earlier ones have stored, unless docs still reads it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        inputs = reads(docs) if _left else []
        if not any(path.rpartition("/")[2] in x for path in _left for x in inputs):
            while _left:
                remove(spark, _left.pop())
        with stored_inside() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality_rules.quality_filter(docs)


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts that are equal after lower-casing A-Z."""
    return exact_dedup.drop_copies(docs)


@_tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return minhash_dedup.drop_near_copies(docs, percent=NEAR_PERCENT)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids of every row of the mix. What it stores stays until the driver ends, as its rows are the result."""
    small_batches(spark)
    coded, ids = piece_lattice.encode(docs, tokenizer_file("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_ids"), F.col(ids).alias("ids"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return rows
        was, docs = docs, store(rows, f"stage{k}")
        if k:
            drop(was)
