"""Upkeep of stored tables: shops' geocodes and cities, index keys, surrogate keys, migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairgrid.functions import text
from fairgrid.operators.search import if_small
from fairgrid.session import shared_folder


def pending_shops(shops: DataFrame) -> DataFrame:
    """Shops that wait for a geocode and have a place to look up."""
    return shops.where((F.col("geocode_status") == "pending") & text.blank_to_null(F.col("location_text")).isNotNull())


def apply_geocodes(shops: DataFrame, results: DataFrame) -> DataFrame:
    """``shops`` with ``results`` (shop_id, latitude, longitude, error, one row a shop).

    A result with an error marks the shop failed and keeps its coordinates; one without completes it and clears the error.
    """
    met = shops.alias("s").join(if_small(results.withColumn("_result", F.lit(True))).alias("r"), "shop_id", "left")
    failed, done = F.col("r.error").isNotNull(), F.col("r._result").isNotNull() & F.col("r.error").isNull()
    changed = {
        "latitude": F.when(done, F.col("r.latitude")).otherwise(F.col("s.latitude")), "longitude": F.when(done, F.col("r.longitude")).otherwise(F.col("s.longitude")),
        "geocode_status": F.when(failed, F.lit("failed")).when(done, F.lit("completed")).otherwise(F.col("s.geocode_status")),
        "geocode_error": F.when(failed, F.col("r.error")).when(~done, F.col("s.geocode_error")),
    }
    return met.select(*(changed.get(c, F.col("shop_id") if c == "shop_id" else F.col(f"s.{c}")).alias(c) for c in shops.columns))


def set_column(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` set where ``changes`` (key, column; one row a key) has a value."""
    told = changes.where(F.col(column).isNotNull()).select(key, F.col(column).alias("_new"))
    return rows.join(if_small(told), key, "left").withColumn(column, F.coalesce("_new", column)).select(rows.columns)


def entity_key(prefix: str, id_column: Column) -> Column:
    """``PREFIX#id``."""
    return F.concat(F.lit(f"{prefix}#"), id_column.cast("string"))


def event_keys(events: DataFrame) -> DataFrame:
    """Own, date and shop keys of events: ``pk, date_pk, date_sk, shop_pk, shop_sk`` beside ``external_id``."""
    own = entity_key("EVENT", F.col("external_id"))
    return events.select(
        "external_id", own.alias("pk"), F.concat(F.lit("DATE#"), F.date_format("start_date", "yyyy-MM-dd")).alias("date_pk"), own.alias("date_sk"),
        entity_key("SHOP", F.col("shop_id")).alias("shop_pk"), F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss").alias("shop_sk"),
    )


def backfill_index_keys(items: DataFrame) -> DataFrame:
    """Events without an index key get the one of their shop where shop and start are there; others stay as they are."""
    ready = (F.col("entity_type") == "EVENT") & text.blank_to_null(F.col("shop_id")).isNotNull() & F.col("start_date").isNotNull()
    return items.withColumn("index_key", F.coalesce("index_key", F.when(ready, entity_key("SHOP", F.col("shop_id")))))


def by_entity(items: DataFrame, kinds: tuple[str, ...] = ("SHOP", "EVENT", "GEOCACHE", "SCRAPE_RUN", "ZIPCODE")) -> dict[str, DataFrame]:
    """The rows of each kind of a mixed table."""
    return {kind: items.where(F.col("entity_type") == kind) for kind in kinds}


def translated(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` with the natural key in ``column`` replaced by the surrogate of ``keys`` (natural, surrogate); null where it is unknown."""
    return rows.join(if_small(keys.select(F.col("natural").alias(column), "surrogate")), column, "left").withColumn(column, F.col("surrogate")).drop("surrogate").select(rows.columns)


def new_surrogates(known: DataFrame, naturals: DataFrame, parts: int = 64) -> DataFrame:
    """``natural, surrogate`` for each value of ``naturals`` (natural) that ``known`` (natural, surrogate) lacks: gapless from its largest surrogate on, in order of the values.

    Values are dealt to ranges and written once in the shared folder; a range's first number is the sum of the counts
    before it, so no task numbers all of them. The same tables give the same numbers, however often this runs.
    """
    fresh = naturals.where(F.col("natural").isNotNull()).select("natural").distinct().join(known.select("natural"), "natural", "left_anti")
    path = shared_folder(fresh.sparkSession, "new-naturals")
    fresh.repartitionByRange(parts, "natural").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = fresh.sparkSession.read.schema(fresh.select("natural", F.lit(0).alias("_part")).schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    largest = known.agg(F.coalesce(F.max("surrogate"), F.lit(0)).cast("long").alias("_largest"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("natural"))
    numbered = dealt.join(F.broadcast(starts), "_part").withColumn("_rank", rank).join(F.broadcast(largest))  # one row
    return numbered.select("natural", (F.col("_largest") + F.col("_start") + F.col("_rank")).alias("surrogate"))


#: Attributes of each kind of a mixed table of JSON items, with their types.
ITEM_FIELDS = {
    "SHOP": {"externalId": "bigint", "name": "string", "latitude": "double", "longitude": "double"},
    "EVENT": {"externalId": "bigint", "name": "string", "startDate": "timestamp_ntz", "shopExternalId": "bigint", "playerCount": "int"},
    "GEOCACHE": {"query": "string", "latitude": "double", "longitude": "double"},
    "SCRAPE_RUN": {"startedAt": "timestamp_ntz", "status": "string", "eventsFound": "int"},
    "ZIPCODE": {"zipcode": "string", "city": "string", "latitude": "double", "longitude": "double"},
}


def typed_items(items: DataFrame, path: str) -> dict[str, DataFrame]:
    """Tables by kind of ``items`` (item, a JSON text each), from one scan of them: ``id``, the kind's typed attributes and ``other``.

    The kind is ``entityType``, the id ``PK`` after its first ``#``. An attribute that has another type is null;
    attributes that a kind doesn't name stay in ``other`` as JSON texts by name. Items are written to ``path`` with a
    folder for each kind, kinds not in ITEM_FIELDS and texts that aren't JSON objects to ``kind=OTHER`` with ``item``.
    """
    told = items.select("item", F.try_parse_json("item").alias("_v")).withColumn("_kind", F.try_variant_get("_v", "$.entityType", "string"))
    kind = F.when(F.col("_kind").isin(list(ITEM_FIELDS)), F.col("_kind")).otherwise(F.lit("OTHER"))
    every = {f"{k.lower()}_{name}": (k, name, t) for k, own in ITEM_FIELDS.items() for name, t in own.items()}
    columns = [F.when(F.col("_kind") == k, F.try_variant_get("_v", f"$.{name}", "string").try_cast(t) if t == "timestamp_ntz" else F.try_variant_get("_v", f"$.{name}", t)).alias(c) for c, (k, name, t) in every.items()]
    known = F.create_map(*(x for k, own in ITEM_FIELDS.items() for x in (F.lit(k), F.array(*(F.lit(n) for n in ("entityType", "PK", "SK", *own))))))
    rest = F.map_filter(F.from_json("item", "map<string,string>"), lambda name, _: ~F.array_contains(known[F.col("_kind")], name))
    identity = F.regexp_extract(F.try_variant_get("_v", "$.PK", "string"), "^[^#]*#(.*)$", 1)
    wide = told.select(kind.alias("kind"), identity.alias("id"), *columns, F.when(kind != "OTHER", rest).alias("other"), F.when(kind == "OTHER", F.col("item")).alias("item"))
    wide.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(path)
    held = items.sparkSession.read.schema(wide.schema).parquet(path)
    tables = {k: held.where(F.col("kind") == k).select("id", *(F.col(f"{k.lower()}_{name}").alias(name) for name in own), "other") for k, own in ITEM_FIELDS.items()}
    return tables | {"OTHER": held.where("kind = 'OTHER'").select("item")}


def migrated(*tables: DataFrame) -> DataFrame:
    """Tables of an older and a newer schema as one: columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
