"""Rules over rows: what is wrong with each, and how often each rule is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid import schema
from fairgrid.functions.text import blank_to_null


def wire_rules() -> dict[str, Column]:
    """Rules of wire events: a name and the condition that breaks it."""
    start, end = F.try_to_timestamp("start_datetime"), F.try_to_timestamp("end_datetime")
    lat, lng = F.coalesce("latitude", "store.latitude"), F.coalesce("longitude", "store.longitude")
    return {
        "no id": F.col("id").isNull(),
        "no name": blank_to_null(F.trim("name")).isNull(),
        "unreadable start": start.isNull(),
        "ends before it starts": end < start,
        "latitude out of range": ~lat.between(-90, 90),
        "longitude out of range": ~lng.between(-180, 180),
        "half a coordinate": lat.isNull() != lng.isNull(),
        "negative cost": F.col("cost_in_cents") < 0,
        "cost without currency": (F.col("cost_in_cents") > 0) & blank_to_null(F.trim("currency")).isNull(),
        "more players than seats": (F.col("capacity") > 0) & (F.col("registered_user_count") > F.col("capacity")),
        "store without a name": F.col("store").isNotNull() & blank_to_null(F.trim("store.name")).isNull(),
    }


def validated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``errors``, the names of the rules that a row breaks, in their order, and ``valid``. A rule that can't be told, as its columns are null, isn't broken."""
    told = F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))
    return rows.withColumn("errors", F.filter(told, lambda x: x.isNotNull())).withColumn("valid", F.size("errors") == 0)


def broken_rules(checked: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: rows that break each rule, also the unbroken ones, from one pass over ``checked``."""
    counts = checked.agg(*(F.count_if(F.array_contains("errors", name)).alias(name) for name in rules))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.col(f"`{n}`") for n in rules)))).alias("rule", "n"))


def read_checked_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events with ``errors`` and ``valid``, corrupt pages as ``file, number, page``, the number where it can be read) of pages saved as JSON documents, a file each."""
    told = spark.read.schema(f"{schema.WIRE_PAGE}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True).withColumn("file", F.input_file_name())
    whole = told.where("_corrupt_record is null").select(F.col("current_page_number").alias("page"), F.posexplode("results").alias("position", "_e")).select("page", "position", "_e.*")
    return validated(whole, wire_rules()), told.where("_corrupt_record is not null").select("file", F.col("current_page_number").alias("number"), F.col("_corrupt_record").alias("page"))
