"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

language ID and toxicity drop rejected documents, exact and near dedup keep one document of each group, packing
lays the rest out in sequences. A null in any column, empty tables and extra columns are handled as the stages'
operators state; rows with a null doc_id pass the two dedup stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm import exact_dedup, langid, minhash, packing, toxicity
from fairgrid.llm.common import documents, materialise, scratch
from fairgrid.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or told by too narrow a margin."""
    ship_package(spark)
    model = langid.fit(langid.training_rows(docs))
    return docs.where(~langid.predictor(model, F.col("text"))["rejected"])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored 0.5 or more."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(model, F.col("text")) < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; a row goes only for its own text, whatever else has its doc_id."""
    ship_package(spark)
    decided = exact_dedup.deduplicate(docs, keep="max")
    dropped = decided.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("dropped_id"), "text_sha256").distinct()
    gone = materialise(dropped, "dropped").alias("gone")
    same = (F.col("rows.doc_id") == F.col("gone.dropped_id")) & (exact_dedup.digest(F.col("rows.text")) == F.col("gone.text_sha256"))
    return docs.alias("rows").join(gone, same, "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; rows whose doc_id has several texts stay as they are."""
    ship_package(spark)
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_h"))
    shared = materialise(texts.groupBy("doc_id").agg((F.min("_h") < F.max("_h")).alias("_shared")).where("_shared").select("doc_id"), "shared-ids")
    alone = docs if shared.isEmpty() else docs.where("doc_id is not null").join(shared, "doc_id", "left_anti")
    decided = minhash.near_duplicates(alone)
    dropped = materialise(decided.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]

#: The language and toxicity stages apply fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; tables of a stage, and the one it read, are removed when its own is written."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            own = made.pop()
            if last:
                made.append(last)
            last = own
    return STAGES[-1][1](spark, docs, sf_dir)
