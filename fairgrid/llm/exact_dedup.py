"""Exact dedup: a log-structured merge index of digests, in DataFrames only.

Texts are hashed once into a written table of ids and digests, dealt to memtables of a bounded number of rows.
``MergeIndex.add`` flushes a memtable: it is pre-aggregated by digest and written as a sorted run in the shared folder.
``compact`` merges all runs into one, keeping one identifier and the row count of each digest. Digests of more than one
row are the hits; a filter of them, a bitmap of bounded size, picks the texts that are read for verification before any
text is shuffled. ``verified`` groups these by digest *and* text, so only texts equal in every byte meet, and the
group-by's map-side combine folds copies before the shuffle. The surviving identifier is the smallest or the largest
(``keep``); the contract's query asks for the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm.common import documents, materialise, new_path

#: A digest with at least this share of all rows is joined by broadcast: there are at most as many of them.
HOT_SHARES = 1000
#: Bits in a part of a filter, as bitmap_construct_agg makes them, and the most parts of one.
PART_BITS, MOST_PARTS = 32_768, 8192


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes as lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class MergeIndex:
    """Sorted digest runs in the shared folder: ``text_sha256, keep_id, group_size``."""

    def __init__(self, spark: SparkSession, keep: str = "min"):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.pick = spark, F.min if keep == "min" else F.max
        self.runs: list[str] = []

    def _flush(self, entries: DataFrame) -> None:
        path = new_path(self.spark, "digest-run")
        (
            entries.repartitionByRange("text_sha256").sortWithinPartitions("text_sha256")
            .write.options(**{"parquet.bloom.filter.enabled#text_sha256": "true", "parquet.bloom.filter.adaptive.enabled": "true"}).parquet(path)
        )
        self.runs.append(path)

    def add(self, batch: DataFrame) -> MergeIndex:
        """Flush one memtable: ``batch`` has ``doc_id`` and ``text_sha256``."""
        self._flush(batch.groupBy("text_sha256").agg(self.pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        return self

    def entries(self) -> DataFrame:
        """All runs, unmerged."""
        return self.spark.read.parquet(*self.runs)

    def compact(self) -> MergeIndex:
        """Merge the runs into one sorted run."""
        merged = self.entries().groupBy("text_sha256").agg(self.pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        self._flush(merged)
        self.runs = self.runs[-1:]
        return self

    def find(self, digests: list[str]) -> DataFrame:
        """Entries of a few digests: row groups are skipped by their range and bloom filter."""
        return self.entries().where(F.col("text_sha256").isin(digests))


def parts_for(digests: int) -> int:
    """Parts of a filter with 16 bits for each of ``digests``, MOST_PARTS of 4 KB at most."""
    parts = 1
    while parts < MOST_PARTS and parts * PART_BITS < 16 * digests:
        parts *= 2
    return parts


def filter_of(hits: DataFrame, parts: int) -> DataFrame:
    """A filter of the digests of ``hits``: ``_part, _bits``."""
    place = _place(parts)
    return hits.select(F.floor(place / PART_BITS).cast("int").alias("_part"), (place % PART_BITS).alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def _place(parts: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(parts * PART_BITS))


def may_be_in(rows: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """``rows`` whose digest the filter ``told`` may hold: all hits, and few others as long as the filter isn't full."""
    placed = rows.withColumn("_place", _place(parts)).withColumn("_part", F.floor(F.col("_place") / PART_BITS).cast("int"))
    at = (F.col("_place") % PART_BITS).cast("int")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place % 32768 as int) div 8 + 1, 1)")), 16, 10).cast("int")
    met = placed.join(F.broadcast(told), "_part")  # 32 MB at most
    return met.where(F.getbit(byte, at % 8) == 1).select(rows.columns)


def verified(rows: DataFrame) -> DataFrame:
    """Distinct byte strings of each digest with more than one row: ``text_sha256, variants``.

    ``rows`` has ``text_sha256`` and ``text``.
    """
    strings = rows.groupBy("text_sha256", "text").agg(F.count(F.lit(1)).alias("_n"))
    return strings.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("variants"), F.sum("_n").alias("_rows")).where("_rows > 1").select("text_sha256", "variants")


def deduplicate(docs: DataFrame, keep: str = "min", memtable_rows: int = 1 << 28) -> DataFrame:
    """Exact copies of whole texts: ``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of ``docs``.

    Null texts count as empty and are copies of each other. Rows sharing a doc_id are one document and share the
    decision on a text; a null doc_id is kept only where its whole group has none. Two different texts with one
    digest (never seen with SHA-256) stop the job rather than lose a text. Very long texts are hashed and compared
    whole; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read. There are two memtables at
    least, and no more rows than ``memtable_rows`` in one.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest(F.col("text")).alias("text_sha256"))
    lean = materialise(keyed.select("doc_id", "text_sha256"), "digests")
    total = lean.count()
    index = MergeIndex(spark, keep)
    memtables = max(2, -(-total // memtable_rows))
    for part in range(memtables):
        index.add(lean.where(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)) == part))
    hits = materialise(index.compact().entries().where("group_size > 1"), "digest-hits")
    parts = parts_for(hits.count())
    texts = may_be_in(keyed.select("text_sha256", "text"), filter_of(hits, parts), parts)
    checked = hits.join(verified(texts), "text_sha256", "left")
    same = F.when(F.col("variants") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("different texts share digest "), "text_sha256")).cast("boolean"))
    checked = materialise(checked.where(same).drop("variants"), "digest-checked")
    hot = checked.where(F.col("group_size") * HOT_SHARES >= total)  # at most HOT_SHARES rows
    cold = checked.where(F.col("group_size") * HOT_SHARES < total)
    of_hot = hot.select("text_sha256", F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_size"), F.lit(True).alias("_hot"))
    met = lean.join(F.broadcast(of_hot), "text_sha256", "left")
    busy = met.where("_hot").select("doc_id", F.col("_hot_id").alias("keep_id"), F.col("_hot_size").alias("group_size"), "text_sha256")
    rest = met.where("_hot is null").select("doc_id", "text_sha256").join(cold, "text_sha256", "left")
    rest = rest.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    both = busy.unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: the largest doc_id of equal texts stays."""
    return deduplicate(documents(spark, sf_dir), keep="max")


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
