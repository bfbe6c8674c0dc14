"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step decodes and works on; a longer single document is a step of its own.
CHUNK_BYTES = 800_000
#: Bytes and rows of an Arrow batch between Spark and Python; a session with smaller ones keeps them.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000

#: Paths that stored() made inside settled(), innermost last.
made: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Only where that setting is absent and all runs in one process, as in tests, a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def of_hadoop(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def deleted_at_exit(spark: SparkSession, name: str) -> None:
    fs, at = of_hadoop(spark, name)
    fs.deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends and lost executors cost nothing.

    The files go when the settled() ends in which they were made, or else with the driver.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if made:
        made[-1].append(path)
    else:
        deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()), without the files of whatever else make() stored on its way."""
    made.append([])
    try:
        out = stored(make())
        kept = made[-1].pop()
    finally:
        for path in made.pop():
            fs, at = of_hadoop(spark, path)
            fs.delete(at, True)
    (made[-1].append if made else lambda path: deleted_at_exit(spark, path))(kept)
    return out


def first_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` different rows of df, those whose key has the smallest hash.

    A cut of hashes goes first that leaves about twice `most` keys, so that at any size few rows are compared and sorted,
    and a hot key takes one seat.
    """
    order = F.shiftrightunsigned(F.xxhash64(key), 1)
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    if n > 4 * most:
        df = df.where(order < int((1 << 63) / n * 2 * most))
    return df.distinct().orderBy(order, *df.columns).limit(most)


def spread_join(left: DataFrame, right: DataFrame, on: str, rows: str, parts: int = 1000) -> DataFrame:
    """left joined to right, which has each key of left once and, in column rows, the number of left's rows with it.

    Keys with more than 1 / parts of all rows are fewer than parts, so they are broadcast, and no shuffle brings a hot
    key's rows together; the others are joined as Spark likes.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) * parts > total).drop(rows)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col(rows) * parts <= total).drop(rows), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a frame that stored() made and that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, at = of_hadoop(spark, name)
        fs.delete(at, True)


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a row also counts for a few bytes of its own."""
    ends = np.cumsum(sizes + 16)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def tidied() -> None:
    """Gives memory that a task no longer needs back to the system: a Python worker lives on for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that thousands of long texts never meet in one; a stricter session setting stays."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def with_text_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[list], dict]], column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (those of keep, if given) and columns computed from one of its columns, in Arrow batches and without a shuffle.

    make() runs once in each task and returns a function from a list of values to {column: list or array}. Only keep goes
    back to Spark, which cannot prune it afterwards. An input column named as an output column is replaced.
    """
    names = [f.name for f in fields]
    if column in names:
        raise ValueError(f"{column} is read and cannot be an output too")
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if column in kept else [F.col(f"`{column}`")]))
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])
    at = source.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        kinds = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            values = batch.column(at)
            sized = pa.types.is_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) if sized else np.zeros(len(values), np.int64)
            for lo, hi in chunks(sizes):
                out = work(values.slice(lo, hi - lo).to_pylist())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *[pa.array(out[f.name], type=f.type) for f in kinds]], names=[*kept, *names])
        del work
        tidied()

    return source.mapInArrow(run, schema)
