"""Sinks: JSON lines, bulk lines, CSV, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON document for each row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def bulk_lines(df: DataFrame, index: str, id_col: str) -> DataFrame:
    """``id, part, line``: an action line (part 0) before each document line (part 1)."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index")))
    document = F.to_json(F.struct(*df.columns))
    return df.select(F.col(id_col), F.posexplode(F.array(action, document)).alias("part", "line"))


def write_bulk(df: DataFrame, path: str, index: str, id_col: str) -> None:
    """Bulk lines as text files; an action and its document stay together, one after the other."""
    pair = F.concat_ws("\n", F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index"))), F.to_json(F.struct(*df.columns)))
    df.select(pair.alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.option("header", True).csv(path)


def padded(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """``line``: columns padded to widths, numbers' texts to the left; longer values are not cut."""
    cells = []
    for name, width in widths.items():
        value = F.coalesce(F.col(name).cast("string"), F.lit("—"))
        short = F.rpad(value, width, " ") if width > 0 else F.lpad(value, -width, " ")
        cells.append(F.when(F.length(value) < abs(width), short).otherwise(value))
    return df.select(F.concat_ws("  ", *cells).alias("line"))


def append_lines(rows: DataFrame, path: str, *columns: str) -> None:
    """Append tab-separated lines to a log folder."""
    rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.mode("append").text(path)


def rate_counters() -> list[Column]:
    """Counters of merged rows."""
    of = [F.count_if(F.col("_status") == status).alias(status) for status in ("created", "updated", "skipped")]
    return [F.count(F.lit(1)).alias("found"), *of]


def rate_metrics(df: DataFrame, name: str) -> DataFrame:
    """``df`` whose counters are published under ``name`` with each batch."""
    return df.observe(name, *rate_counters())
