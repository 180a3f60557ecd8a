"""What the training-data operators share: shared storage, vocabulary paths, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that one step of a Python operator holds at once, beside single longer texts.
STEP_CHARS = 2_000_000
#: Rows of a counted table that make a partition.
PART_ROWS = 25_000
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where a local session names none (as in tests) a folder below the warehouse is set; on a cluster that is an error, as a warehouse may be on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned inside deletes its shuffle files once it has run, not when the driver happens to collect its garbage. For plans that run once."""
    named = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(named, "false")
    spark.conf.set(named, "true")
    try:
        yield
    finally:
        spark.conf.set(named, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, in no more partitions than these need: a task of a later shuffle leaves three files and its log, however few rows it has."""
    seen = Observation()
    with shuffles_dropped(df.sparkSession):
        kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get.get("n")
    n = kept.count() if n is None else n
    return kept.coalesce(max(1, -(-n // PART_ROWS))), n


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write inside, once the block is left: what is read from them has to be consumed by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def smallest(df: DataFrame, of: str, turn: str, most: int | Column) -> DataFrame:
    """Of the distinct (of, turn) of df those with the `most` smallest turns of each value of `of`. Taken twice, so that no task sees a whole value's rows."""
    part = F.pmod(F.xxhash64(turn), F.lit(256))
    first = F.row_number().over(Window.partitionBy(of, part).orderBy(turn))
    second = F.row_number().over(Window.partitionBy(of).orderBy(turn))
    found = df.select(of, turn).distinct().withColumn("_place", first).where(F.col("_place") <= most)
    return found.withColumn("_place", second).where(F.col("_place") <= most).drop("_place")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again."""
    path = table_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


_HELD: dict[object, object] = {}
_T = TypeVar("_T")


def held(key: object, build: Callable[[], _T]) -> _T:
    """What build() gives, kept in this worker process for tasks to come. A worker keeps one such thing: that of the operator at work."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go of what this worker process keeps for another operator."""
    _HELD.clear()


def small_batches(spark: SparkSession, rows: int = 1_000) -> SparkSession:
    """Have Spark hand rows to Python in batches of so many, for tables of long texts: executor and worker hold less at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the Python strings of one text column (null: empty).

    A slice holds about `most` bytes of text, so that a batch of very long texts needs no more memory than one of short texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most:
                yield _slice(batch, column, start, i)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield _slice(batch, column, start, batch.num_rows)


def _slice(batch: pa.RecordBatch, column: pa.Array, start: int, stop: int) -> tuple[pa.RecordBatch, list[str]]:
    return batch.slice(start, stop - start), [t or "" for t in column.slice(start, stop - start).to_pylist()]
