"""Helpers that several operators share: the shared folder, materialised tables, ranks without hot tasks."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one is set only for a local master without one, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"fairgrid-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scopes = threading.local()


def _on_store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed with the scope that it was made in, and else when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/fairgrid/{name}-{uuid.uuid4().hex}"
    store, hadoop_path = _on_store(spark, path)
    store.deleteOnExit(hadoop_path)
    for made in getattr(_scopes, "open", []):
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A scope that removes, at its end, the tables made in it by this thread.

    It yields the list of their paths; what is taken off the list stays.
    """
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield made
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in made:
            store, hadoop_path = _on_store(spark, path)
            store.delete(hadoop_path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_table: dict[tuple, Any] = {}


def worker_table(key: tuple, make: Callable[[], Any]) -> Any:
    """The table ``key`` of this Python worker; workers serve many stages, and each holds one table at a time."""
    if key not in _table:
        _table.clear()
        _table[key] = make()
    return _table[key]


def release_table() -> None:
    """Let go of the table in this Python worker and of memory that Arrow keeps for later."""
    _table.clear()
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text, the value that folds are cut by."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def rank_buckets(rows: int) -> int:
    """Buckets per key for :func:`positions`: about 20 000 rows each, however large one key is."""
    return max(16, rows // 20_000)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Add ``name``: the gapless position from 0 of each row among the rows with its ``keys``.

    Rows of a key are spread over ``buckets`` by a hash of ``order``; a bucket's start is the sum of the
    counts before it, so no task ever sorts a whole key. ``df`` is read twice and should be materialised.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by).orderBy(*order)
    return dealt.join(starts, by).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start")


#: Rows that a task takes in its stride, so that no key of a smaller table is hot.
HOT_ROWS = 1 << 20


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``many`` with ``one``, a row a key, where a key may hold a third of ``many``: keys with a thousandth of its rows or more meet by broadcast.

    Both should be materialised; ``many`` is read twice, or, with fewer than HOT_ROWS rows, joined as it is; ``rows`` is
    their number where it is known, or a bound. ``how`` is ``inner`` or ``left``.
    """
    out = [*many.columns, *(c for c in one.columns if c != key)]
    if (many.count() if rows is None else rows) < HOT_ROWS:
        return many.join(one, key, how).select(out)
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.join(F.broadcast(counts.agg(F.sum("_n").alias("_all"))), F.col("_n") * 1000 >= F.col("_all")).select(key)  # 1000 keys at most
    few = one.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    marked = many.join(F.broadcast(few), key, "left")
    rest = marked.where(F.col("_hot").isNull()).select(many.columns).join(one, key, how)
    return marked.where("_hot").select(out).unionByName(rest.select(out))
