"""Shared helpers: written intermediate tables, Arrow batch mapping, clash-free column names."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Rows of an Arrow batch that are turned into Python strings at a time.
SLICE = 256
#: A written table of so many bytes or less, as counted, is broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch between Spark and Python while an intermediate table is written.
ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, else, on one machine only, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (where or LOCAL_CHECKPOINTS).rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_table(spark: SparkSession, where: str) -> None:
    """Delete a table that cut() wrote. A stopped session leaves it to whoever cleans the folder."""
    if spark._jsc.sc().isStopped():
        return
    fs, path = _path(spark, where)
    fs.delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile tasks get Arrow batches of ROWS rows at most: what stands outside the heap stays small."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", None
    with contextlib.suppress(Exception):
        before = spark.conf.get(name)
    try:
        if before is None or not 0 < int(before) <= ROWS:
            spark.conf.set(name, str(ROWS))
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def give_back() -> None:
    """Free memory of this worker goes back to the system, as workers stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)  # glibc only


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it again: lineage ends, lost executors don't matter.

    Returns the table and its path; drop_table() deletes it early, the end of the driver's process at the latest.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(where)
    atexit.register(_quietly_drop, spark, where)
    return spark.read.schema(df.schema).parquet(where), where


class Scratch:
    """Tables written on the way to a result that is written too; leaving the with block deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in self.made])

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(cut(df, name))
        return self.made[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for table, where in self.made:
            if any(table is t for t in tables):
                drop_table(self.spark, where)
        self.made = [m for m in self.made if not any(m[0] is t for t in tables)]


def _quietly_drop(spark: SparkSession, where: str) -> None:
    try:
        drop_table(spark, where)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """df.mapInArrow() by a function from small batches to columns; make() is called once a task, for its tables.

    make() returns None for a batch that gives no rows.
    """
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                columns = f(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c.name], type=c.type) if not isinstance(columns[c.name], (pa.Array, pa.ChunkedArray)) else columns[c.name] for c in target], schema=target)
        del f
        give_back()

    return df.mapInArrow(run, types)


def null_to_empty(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin as asked and that df doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(table: DataFrame, row_bytes: int, numbers: str | None = None) -> DataFrame:
    """A written table, to be broadcast if it is small: row_bytes for each row and 8 for each element of the column numbers.

    Its size is counted, not guessed. Texts that meet a small table stay where they are; any larger table is shuffled.
    """
    more = F.coalesce(F.sum(F.size(numbers)), F.lit(0)) if numbers else F.lit(0)
    rows, elements = table.agg(F.count(F.lit(1)), more).first()
    return F.broadcast(table) if rows * row_bytes + 8 * elements <= BROADCAST_BYTES else table


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone, a written table of one column doc_id without repeats; null equals null."""
    (name,) = fresh(docs, "gone__")
    gone = bounded(gone, 16).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]), "left_anti")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
