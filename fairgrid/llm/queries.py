"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairgrid.session import ship_package
from fairgrid.llm import exact_dedup, hard_negatives, langid, minhash, online_packing, packing, piece_dropout, prefix_trie, sharding, token_counts, toxicity, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``opN_<name>`` for each operator."""
    own = {
        "op1_language_id": langid.op1_language_id,
        "op2_merge_dropout": piece_dropout.op2_merge_dropout,
        "op3_balanced_sharding": sharding.op3_balanced_sharding,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_warc": warc.op7_warc,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_vector_search": vectors.op9_vector_search,
        "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
        "op11_online_packing": online_packing.op11_online_packing,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }
    return {name: with_package(query) for name, query in own.items()}


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with this package on the executors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express."""
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op7_warc": warc.OP7_SQL, "op10_minhash_near_dedup": minhash.OP10_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
