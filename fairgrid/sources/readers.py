"""Readers: paged API results, access logs, ZIP and price files."""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fairgrid import schema
from fairgrid.functions.text import blank_to_null

# Fields of an access-log line, in order.
LOG_FIELDS = (
    "date time edge bytes ip method host uri status referer agent query cookie result request_id host_header protocol request_bytes time_taken forwarded ssl_protocol ssl_cipher "
    "response_result protocol_version fle_status fle_fields port first_byte detailed_result content_type content_length range_start range_end"
).split()
LEAST_FIELDS = 10


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages saved as JSON documents: a row for each event."""
    pages = spark.read.schema(schema.WIRE_PAGE).json(path, multiLine=True)
    return pages.select(F.col("current_page_number").alias("page"), F.posexplode("results").alias("position", "_e")).select("page", "position", "_e.*")


def _told(value: object, kind: T.DataType) -> object:
    """A JSON value as Spark takes it: objects by their schema's fields, what they lack is null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_told(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_told(x, kind.elementType) for x in value]
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value


class PagedEvents(DataSource):
    """``spark.read.format("paged_events")``: a partition for each page; ``load_page`` of a subclass fetches it, on an executor.

    Rows are ``page, position`` and the fields of a wire event. Options: ``total`` and ``page_size`` (250); of a stream
    ``pages_per_batch`` (1), and ``from_page``, the last page that is already in, when it starts again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_events"

    def schema(self) -> str:
        return "page int, position int, " + ", ".join(f"{name} {kind}" for name, kind in schema.WIRE_FIELDS.items())

    def pages(self) -> int:
        """Number of pages; a subclass may ask the source."""
        return -(-int(self.options.get("total", "0")) // int(self.options.get("page_size", "250")))

    @abstractmethod
    def load_page(self, page: int) -> list[dict]:
        """Events of one page as JSON objects; a subclass fetches them."""

    def rows(self, page: int, kind: T.StructType) -> Iterator[tuple]:
        """The rows of one page; ``kind`` is the schema of a row."""
        for position, event in enumerate(self.load_page(page)):
            yield _told({**event, "page": page, "position": position}, kind)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _PagedStream(self, schema)


class _PagedStream(DataSourceStreamReader):
    """Micro-batches of a bounded number of pages; the driver plans page numbers, executors fetch the pages."""

    def __init__(self, source: PagedEvents, kind: T.StructType):
        self.source, self.kind, self.most = source, kind, int(source.options.get("pages_per_batch", "1"))
        self.at = int(source.options.get("from_page", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": max(self.at, min(self.source.pages(), self.at + self.most))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["page"])  # also where a restarted query repeats its last batch
        return [InputPartition(page) for page in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.rows(partition.value, self.kind)


class _PagedReader(DataSourceReader):
    def __init__(self, source: PagedEvents, kind: T.StructType):
        self.source, self.kind = source, kind

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in range(1, self.source.pages() + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.rows(partition.value, self.kind)


def read_access_logs(spark: SparkSession, path: str, first_date: str | None = None, packed_only: bool = False) -> DataFrame:
    """Tab-separated log lines, comments skipped, lines of fewer than ten fields dropped, missing fields ''.

    ``packed_only`` reads ``*.gz`` alone, where a folder holds each log packed and unpacked.
    """
    parts = F.split("value", "\t")
    lines = spark.read.option("pathGlobFilter", "*.gz" if packed_only else "*").text(path).where(~F.startswith("value", F.lit("#"))).select(parts.alias("_p")).where(F.size("_p") >= LEAST_FIELDS)
    rows = lines.select(*(F.coalesce(F.get("_p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(LOG_FIELDS)))
    typed = rows.withColumn("bytes", F.expr("try_cast(bytes as bigint)")).withColumn("datetime", F.try_to_timestamp(F.concat_ws(" ", "date", "time")))
    return typed.where(F.col("date") >= first_date) if first_date else typed


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder metric lines of a log."""
    return spark.read.text(path).where(F.contains("value", F.lit("[GEOCODE]"))).withColumnRenamed("value", "line")


def read_zipcodes(spark: SparkSession, path: str) -> DataFrame:
    """US rows with a five-digit code and numeric coordinates of a ZIP file; the last row of a code wins."""
    names = ["country_code", "zipcode", "city", "state", "state_code", "county", "county_code", "lat", "lng"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names)).withColumn("_row", F.monotonically_increasing_id())
    good = raw.where((F.col("country_code") == "US") & F.col("zipcode").rlike(r"^\d{5}$"))
    good = good.withColumn("latitude", F.expr("try_cast(lat as double)")).withColumn("longitude", F.expr("try_cast(lng as double)")).where("latitude is not null and longitude is not null")
    last = good.groupBy("zipcode").agg(F.max_by(F.struct("city", "state", "state_code", "latitude", "longitude"), "_row").alias("_last"))
    return last.select("zipcode", "_last.*")


def read_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prices, rejects) of a JSON array or a CSV with a header; header names may vary and a plain price is in USD."""
    if path.rstrip("/").endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
    else:
        raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = {c.lower().replace("_", ""): c for c in raw.columns}

    def pick(*aliases: str) -> F.Column:
        found = [blank_to_null(F.trim(F.col(f"`{have[a]}`").cast("string"))) for a in aliases if a in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    usd, cny = F.coalesce(pick("priceusd", "usd"), pick("price")), pick("pricecny", "cny")
    unreadable = lambda c: c.isNotNull() & (c.try_cast("double").isNull() | F.isnan(c.try_cast("double")))
    rows = raw.select(
        pick("cardname", "name", "card").alias("card"), pick("cardnumber", "number").alias("card_number"), pick("set", "setcode").alias("set"),
        usd.try_cast("double").alias("price_usd"), cny.try_cast("double").alias("price_cny"), (unreadable(usd) | unreadable(cny)).alias("_bad"),
    )
    reason = F.when(F.col("card").isNull(), "no name").when(F.col("_bad"), "unreadable price").when(F.col("price_usd").isNull() & F.col("price_cny").isNull(), "no price").when(F.least("price_usd", "price_cny") < 0, "negative price")
    told = rows.withColumn("reason", reason).drop("_bad")
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def known_ids(spark: SparkSession, path: str, column: str = "osm_id") -> DataFrame:
    """The distinct ids of a file of JSON lines."""
    return spark.read.schema(f"`{column}` long").json(path).where(F.col(column).isNotNull()).distinct()


def card_fields(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Fields of event cards in HTML, each id once, the first card of an id wins: ``external_id`` and its title, date, time, fee, players, format, region, store and image; what a card lacks is null."""
    cards = pages.select(F.posexplode(F.split(html_col, 'data-testid="eventCard-(?=[0-9])')).alias("_n", "_c"), F.monotonically_increasing_id().alias("_p")).where("_n > 0")
    cards = cards.withColumn("_c", F.regexp_replace("_c", "(?s)<!--.*?-->", ""))
    inner = lambda c: blank_to_null(F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    part = lambda name: inner(F.regexp_extract("_c", f'(?s)data-testid="eventCard-{name}"[^>]*>(.*?)</', 1))
    after = lambda icon: inner(F.regexp_extract("_c", f'(?s)<svg[^>]*{icon}[^>]*>.*?</svg>(.*?)</(?:div|span|p)>', 1))
    fields = F.struct(
        part("text-title").alias("title"), F.expr("try_to_date(date_text, 'MMM d, yyyy')").alias("date"), part("text-time").alias("time"), part("text-entryFee").alias("fee"),
        F.regexp_extract("_c", r"([0-9]+)\s*Players", 1).try_cast("int").alias("players"), after("trophy").alias("format"), part("text-storeName").alias("region"), after("store").alias("store"),
        blank_to_null(F.regexp_extract("_c", '<img[^>]*src="([^"]*)"', 1)).alias("image"),
    )
    rows = cards.withColumn("date_text", part("text-date")).select("_p", "_n", F.regexp_extract("_c", "^([0-9]+)", 1).alias("external_id"), fields.alias("_f"))
    return rows.groupBy("external_id").agg(F.min_by("_f", F.struct("_p", "_n")).alias("_f")).select("external_id", "_f.*")
