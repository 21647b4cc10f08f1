"""Helpers shared by the corpus operators: shared storage, word splitting, value binding."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of blanks as Java regular expression: space and 0x09 to 0x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='flowloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/flowloom-{uuid.uuid4().hex}/{tag}"
    atexit.register(remove, spark, path.rpartition("/")[0])
    if _scopes:
        _scopes[-1].append(path.rpartition("/")[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies; a stopped session leaves it."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_scopes: list[list[str]] = []


@contextlib.contextmanager
def stored_inside() -> Iterator[list[str]]:
    """The folders of all tables that store() and scratch() make inside the block."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(made)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside the block are removed at its end, but for those given to the function that it yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._flowloom_path.rpartition("/")[0])
        return df

    with stored_inside() as made:
        yield keep
        for path in [x for x in made if x not in kept]:
            remove(spark, path)
            made.remove(path)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it again. Lost executors cost nothing that is written."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._flowloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that store() has written, once nothing reads it any more."""
    remove(df.sparkSession, df._flowloom_path.rpartition("/")[0])


@contextlib.contextmanager
def settings(spark: SparkSession, options: dict[str, object]) -> Iterator[None]:
    """Session options for the actions inside the block; what was set before holds again afterwards."""
    was = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder whole or not at all; a repeated task writes the same bytes."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        fs.move(part, f"{root}/{name}")
    else:
        fs.delete_file(part)


def reads(df: DataFrame) -> list[str]:
    """The folders and files that df's plan reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), []
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths().iterator()
            while roots.hasNext():
                found.append(roots.next().toString())
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, compared without case as Spark does."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession, most: str = "4MB") -> SparkSession:
    """For the whole session, Arrow batches of at most `most` bytes of texts instead of 64 MB; a value set by the user stays.

    The registered queries call this, because their rows are made after they return; the operators leave the session alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, most)
    return spark
