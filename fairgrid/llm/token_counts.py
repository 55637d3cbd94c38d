"""Token counts: lengths only, from a public tokenizer, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fairgrid.llm.common import documents
from fairgrid.llm.token_cache import piece_ids


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    Batches are balanced by bytes and long texts are split at boundaries where both sides encode alone, so a
    count equals the library's for the whole text. Null and empty texts count 0 bytes and 0 tokens. Repeated
    rows give repeated rows; a null id stays null; an empty table gives an empty result; other columns are
    not read.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in encoder.of(texts))])
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64()), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: whole ``documents`` with the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
