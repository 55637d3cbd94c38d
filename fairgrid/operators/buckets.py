"""A keyed table in buckets of the key's hash: an upsert rewrites the buckets whose rows it changes, and publishes a version.

``data/_write=N/_bucket=B`` holds a bucket as write N left it, ``changes/_write=N`` the rows that write N created or
updated, ``log/_write=N`` its counters, ``manifest/_write=N`` which write holds each bucket. A version counts once its
manifest is whole, so readers see the version before or after an upsert, never a part of it, and an upsert repeated
under its number starts again from the version before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairgrid.operators import merge

COUNTERS = ["found", "created", "updated", "skipped", "rejected", "stores", "last_page"]


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@dataclass(frozen=True)
class BucketedTable:
    """The table in ``folder``, whose rows have ``schema`` and are told apart by ``key``.

    ``buckets`` is fixed for the table's life: choose it so that a bucket is some hundred megabytes; the manifest, a
    number for each bucket, is what the driver reads.
    """

    spark: SparkSession
    folder: str
    key: str
    schema: T.StructType
    buckets: int = 256

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        store, top = _store(self.spark, f"{self.folder}/manifest")
        held = [str(f.getPath()) for f in store.listStatus(top)] if store.exists(top) else []
        return sorted(int(p.rsplit("_write=", 1)[1]) for p in held if "_write=" in p and store.exists(_store(self.spark, f"{p}/_SUCCESS")[1]))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Which write holds each bucket, in the newest version, or the newest under ``before``."""
        told = [v for v in self.versions() if before is None or v < before]
        if not told:
            return {}
        rows = self.spark.read.schema("bucket int, held_by long").parquet(f"{self.folder}/manifest/_write={told[-1]}").collect()  # a row for each bucket
        return {r["bucket"]: r["held_by"] for r in rows}

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of the newest version (under ``before``), of all buckets or ``only`` some; other buckets' files are not listed."""
        held = {b: w for b, w in self.manifest(before).items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/_write={w}/_bucket={b}" for b, w in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def changes(self, version: int) -> DataFrame:
        """The rows that a version created or updated, with ``_status``."""
        schema = T.StructType([*self.schema.fields, T.StructField("_status", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/changes/_write={version}")

    def log(self) -> DataFrame:
        """A row of counters for each published version, also of those whose files are gone."""
        schema = "version long, " + ", ".join(f"{c} long" for c in COUNTERS)
        told = self.versions()
        if not told:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/log").where(F.col("version") <= told[-1])
        return rows.select("version", *COUNTERS)

    def upsert(self, incoming: DataFrame, compared: list[str], version: int, as_of: object = None, store: str | None = None, page: str | None = None, bookkeeping: tuple[str, ...] = ()) -> dict[str, int]:
        """Merge ``incoming`` (one row a key) and publish it as ``version``; returns the counters, those of the log if it is published already.

        Rows with a null key are counted as rejected. Rows that differ in no ``compared`` column are skipped. Only
        buckets with incoming rows are read, and only those with a created or updated row are written. ``store`` and
        ``page`` name columns whose distinct values and maximum are logged; ``bookkeeping`` columns of ``incoming``
        aren't kept.
        """
        if version in self.versions():
            row = self.log().where(F.col("version") == version).first()
            return {c: row[c] for c in COUNTERS}
        asked = Observation()
        facts = [F.count(F.lit(1)).alias("found"), F.count_if(F.col(self.key).isNull()).alias("rejected"), F.max(F.col(page) if page else F.lit(None).cast("long")).cast("long").alias("last_page")]
        rows = incoming.withColumn("_bucket", self.bucket())
        told = rows.agg(*facts, F.count_distinct(F.col(store) if store else F.lit(None).cast("string")).alias("stores"), F.collect_set(F.when(F.col(self.key).isNotNull(), F.col("_bucket"))).alias("touched")).first()  # as many buckets as there are
        touched = set(told["touched"])
        stored = self.read(version, touched)
        merged = merge.merge(stored, incoming.drop(*bookkeeping), self.key, compared, as_of)
        counted = merged.observe(asked, *(F.count_if(F.col("_status") == s).alias(s) for s in ("created", "updated", "skipped")))
        counted.where(F.col("_status").isin("created", "updated")).write.mode("overwrite").parquet(f"{self.folder}/changes/_write={version}")
        changes = self.changes(version).withColumn("_bucket", self.bucket())
        changed = {r[0] for r in changes.select("_bucket").distinct().collect()}
        if changed:
            kept = self.read(version, changed).join(changes.select(self.key), self.key, "left_anti")
            post = kept.select(self.schema.names).unionByName(changes.select(self.schema.names)).withColumn("_bucket", self.bucket())
            post.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/_write={version}")
        counters = {c: told[c] for c in ("found", "rejected", "stores", "last_page")} | asked.get
        row = (version, *(counters[c] for c in COUNTERS))
        self.spark.createDataFrame([row], f"version long, {', '.join(f'{c} long' for c in COUNTERS)}").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/_write={version}")
        self.publish(version, self.manifest(version) | dict.fromkeys(changed, version))
        return {c: counters[c] for c in COUNTERS}

    def publish(self, version: int, held: dict[int, int]) -> None:
        """Write the manifest, whose marker makes the version count."""
        self.spark.createDataFrame(sorted(held.items()), "bucket int, held_by long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/_write={version}")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forget all but the newest ``keep`` versions and remove the writes that none of them needs; returns these. Readers of older versions must be done."""
        told = self.versions()
        old, kept = told[:-keep], told[-keep:]
        needed = {w for v in kept for w in self.manifest(v + 1).values()} | set(kept)
        gone = [v for v in old if v not in needed]
        for part, numbers in (("manifest", old), ("changes", old), ("data", gone)):
            for v in numbers:
                store, path = _store(self.spark, f"{self.folder}/{part}/_write={v}")
                store.delete(path, True)
        return gone
