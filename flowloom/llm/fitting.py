"""What the two classifiers share: folds, the bounded sample they learn from, Adam, and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, id: str, text: str, where: Column, rows: int, most_bytes: int, most_ones: int | None = None) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most `rows` labelled documents, those with the smallest hash of their id, without texts of more than most_bytes; the share of label 1 among all labels.

    With most_ones, up to so many have label 1, however rare it is. The ids are chosen among the labels alone, so no text is
    shuffled; they are at most `rows` and go to every executor. An id with several labels has the larger, one with several
    texts the text of the smallest hash. The order is that of the ids' hashes, whatever files the input came in."""
    marks = labels.select(labels[id].alias("id"), labels[label].cast("double").alias("y")).where("y IS NOT NULL").where(where).groupBy("id").agg(F.max("y").alias("y"))
    first = lambda m, n: m.orderBy(F.xxhash64("id"), "id").limit(n)
    if most_ones is None:
        chosen = first(marks, rows)
    else:
        ones = first(marks.where("y = 1"), most_ones)
        chosen = ones.union(first(marks.where("y = 0"), rows - ones.count()))
    own = docs.select(docs[id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    one = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = sorted(one.select(F.xxhash64("id").alias("h"), "id", "text", "y").collect(), key=lambda r: (r["h"], str(r["id"])))  # bounded by rows and most_bytes
    return [r["text"] for r in found], np.array([r["y"] for r in found], np.float32), float(marks.agg(F.avg("y")).first()[0] or 0.5)


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def score_texts(docs: DataFrame, model, text: str, carry: list[str], name: str = "score") -> tuple[DataFrame, str]:
    """The carried columns and the model's score of each whole text. model.score(Arrow texts) -> array; its size is fixed."""
    spark = docs.sparkSession
    (name,) = fresh(docs, name)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry))).alias("own"), docs[text].alias("text"))
    schema = T.StructType([rows.schema["own"], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)).astype(np.float64))], names=["own", name])

    scored = rows.mapInArrow(run, schema)
    return scored.select(*(F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(carry)), name), name


def epochs(n: int, batch: int, times: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(epoch, rows) for each mini-batch."""
    rng = np.random.default_rng(seed)
    for e in range(times):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            yield e, order[lo : lo + batch]


Scorer = Callable[[pa.Array], np.ndarray]
