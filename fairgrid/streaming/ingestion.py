"""The ingestion cycle as a stream: pages, canonical rows, an upsert of touched buckets, counters, published metrics; and the same by keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from fairgrid.operators import merge
from fairgrid.operators.buckets import BucketedTable


def ingest(
    stream: DataFrame, table: BucketedTable, checkpoint: str, order: list[str], compared: list[str],
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, as_of: object = None, store: str | None = None, page: str | None = None,
) -> StreamingQuery:
    """Start merging the micro-batches of ``stream`` into ``table``: the last row of a key in ``order`` wins, unchanged rows are skipped.

    A batch is published under its number: repeated after a failure, it starts from the version before it, or, when
    its version is whole, changes nothing. ``prepare`` makes table rows of stream rows and must keep the columns of
    ``order``, which stay out of the table unless they are its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        incoming = prepare(rows)
        nameless = merge.without_key(incoming, table.key)
        last = merge.last_of_batch(incoming.where(F.col(table.key).isNotNull()), table.key, order).unionByName(nameless)
        extra = tuple(c for c in last.columns if c not in table.schema.names)
        table.upsert(last, compared, number, as_of, store, page, extra)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def page_stream(spark: SparkSession, table: BucketedTable, source: str = "paged_events", **options: object) -> DataFrame:
    """The stream of a paged source from where ``table`` ends: pages of published batches are not fetched again."""
    last = table.log().agg(F.coalesce(F.max("last_page"), F.lit(0))).first()[0]
    return spark.readStream.format(source).options(from_page=last, **options).load()


def run_row(table: BucketedTable, started_at: object, completed_at: object) -> DataFrame:
    """The run log's row of all published batches: sums of the counters and the rounded percent skipped; completed, as failed runs publish nothing."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "created", "updated", "skipped", "rejected")]
    told = table.log().agg(F.count(F.lit(1)).alias("batches"), *sums, F.max("last_page").alias("pages"))
    rate = F.floor(F.try_divide(100.0 * F.col("skipped"), F.col("found")) + 0.5).alias("skip_rate")
    return told.select(F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), F.lit("completed").alias("status"), "*", rate)


class MetricsToTable(StreamingQueryListener):
    """Appends the counters that a stream observes to a table, a row for each batch, and a row where a query fails.

    ``path`` gets Parquet rows ``name, run_id, batch, metric, value, error``; counters are those of ``observe(name, ...)``.
    """

    SCHEMA = "name string, run_id string, batch long, metric string, value long, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        """Nothing to publish yet."""

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        """Nothing to publish."""

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        progress = event.progress
        self._append([(name, str(progress.runId), progress.batchId, metric, int(value), None) for name, row in progress.observedMetrics.items() for metric, value in row.asDict().items() if value is not None])

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        if event.exception:
            self._append([(None, str(event.runId), None, None, None, event.exception.split("\n")[0][:500])])


def published(spark: SparkSession, path: str) -> DataFrame:
    """What :class:`MetricsToTable` wrote, a row for each batch and name with a map of counters; a repeated batch counts once."""
    rows = spark.read.schema(MetricsToTable.SCHEMA).parquet(path).where("batch is not null").groupBy("name", "batch", "metric").agg(F.max_by("value", "run_id").alias("value"))
    return rows.groupBy("name", "batch").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("counters"))


class _Latest(StatefulProcessor):
    """The newest row of a key as a JSON text, and a timer that drops it."""

    def __init__(self, columns: list[str], compared: list[str], order: str, days: int):
        self.columns, self.compared, self.order, self.days = columns, compared, order, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "row string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.concat(list(rows)).sort_values(self.order, kind="stable").iloc[-1:]
        own = json.loads(last[self.columns].to_json(orient="records", date_format="iso", date_unit="us"))[0]
        told = self.held.get() if self.held.exists() else None
        before = json.loads(told[0]) if told else None
        if before is None:
            status = "created"
        else:
            status = "updated" if any(before[c] != own[c] for c in self.compared) else "skipped"
        if status != "skipped":
            self.held.update((json.dumps(own),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last[self.order].iloc[0].timestamp() * 1000) + self.days * 86_400_000)
        yield pd.DataFrame({"key": [str(key[0])], "status": [status], "row": [json.dumps(own if before is None or status == "updated" else before)]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        row = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"key": [str(key[0])], "status": ["expired"], "row": [row[0] if row else None]})

    def close(self) -> None:
        """Nothing is open."""


def latest_by_state(stream: DataFrame, key: str, order: str, compared: list[str], late: str = "1 hour", days: int = 90) -> DataFrame:
    """``key, status, row`` of a stream whose keys are held in state: ``created``, ``updated`` or ``skipped`` by each batch, ``expired`` at the end.

    ``order`` is the event time, of which the last row of a batch wins; ``row`` is the held row as JSON. A key that
    isn't seen for ``days`` of event time is dropped by a timer when the watermark passes, and is new when it returns.
    Rows with a null key, or later than ``late``, take no part. Needs the RocksDB state store.
    """
    columns = [c for c in stream.columns if c not in (key, order)]
    rows = stream.where(F.col(key).isNotNull()).withWatermark(order, late)
    out = T.StructType.fromDDL("key string, status string, row string")
    return rows.groupBy(key).transformWithStateInPandas(_Latest(columns, compared, order, days), out, "append", "eventTime")
