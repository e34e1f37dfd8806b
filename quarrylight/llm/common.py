"""Helpers shared by the text operators: shared storage, hashing rules, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, local runs).
DEFAULT_SHARED = "/tmp/checkpoints/quarrylight"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, on a local master only,
    it is set here, and on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", DEFAULT_SHARED)
        found = DEFAULT_SHARED
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _path(spark, path)
    fs.delete(jpath, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quarrylight-{name}-{uuid.uuid4().hex[:12]}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by then; the folder is scratch space
            return

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrylight_path = path
    return out


def bucketed(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """df as a table in the shared folder that is bucketed by columns: grouping by them needs no shuffle. Lives as long as the
    driver."""
    spark = df.sparkSession
    path, named = fresh_path(spark, name), f"quarrylight_{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {named}")
        except Exception:  # the session may be gone by then
            return

    atexit.register(clean)
    df.write.bucketBy(buckets, columns).option("path", path).option("compression", "zstd").saveAsTable(named)
    return spark.table(named)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for df in frames:
        remove(df.sparkSession, df._quarrylight_path)


def small_side(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """df, a written table of few narrow columns, marked for broadcast if it has at most ``rows`` rows; else as it is, for a
    shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int = 400_000, salts: int = 16) -> DataFrame:
    """left joined with right, a written table with one narrow row for each key, where one key may hold much of left.

    Up to ``rows`` rows, right is broadcast; beyond, rows of left are dealt over ``salts`` parts of their key, and right is
    repeated for each part."""
    if right.count() <= rows:
        return left.join(F.broadcast(right), key, how)
    salt = unused(left, "_salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt], how).drop(salt)


def put_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes data as one file of the shared folder through Hadoop's file system; returns its path."""
    path = f"{fresh_path(spark, name)}/{name}"
    jpath, fs = _path(spark, path)
    out = fs.create(jpath, True)
    try:
        for i in range(0, len(data), 1 << 22):
            out.write(data[i : i + (1 << 22)])
    finally:
        out.close()
    return path


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id written as text, modulo m (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_struct(df: DataFrame, value: Column, fields: list[str]) -> DataFrame:
    """df with the fields of a struct as further columns; columns of df that have their names are replaced."""
    kept = [c for c in df.columns if c.lower() not in {f.lower() for f in fields}]
    name = unused(df, "_made")
    made = df.withColumn(name, value)
    return made.select(*[made[f"`{c}`"] for c in kept], *[made[f"`{name}`"][f].alias(f) for f in fields])


def given_back() -> None:
    """Hands the memory that this worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function over batches, handing its memory back to the system at the end: a Python worker outlives its
    task, and what it keeps is lacking to the tasks and stages that follow."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return tidied


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that one holds at most max_bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)
