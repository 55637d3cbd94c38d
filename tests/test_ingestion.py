"""The ingestion cycle: paged streams, bucketed tables, restarts, keyed state, published counters."""

import os
from collections import Counter

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from fairgrid.operators import merge
from fairgrid.operators.buckets import BucketedTable
from fairgrid.schema import COMPARED_EVENT
from fairgrid.sources import readers, sinks
from fairgrid.streaming import ingestion

ROW = "external_id long, name string, n int, image string, created_at int"


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def bucketed(spark, tmp_path, buckets=16, schema=ROW, name="table"):
    return BucketedTable(spark, folder(tmp_path, name), "external_id", spark.createDataFrame([], schema).schema, buckets)


def rows(spark, values, schema="external_id long, name string, n int, image string"):
    return spark.createDataFrame(values, schema)


def held(table, **kw):
    return {r.external_id: (r.name, r.n, r.image, r.created_at) for r in table.read(**kw).collect()}


def written(tmp_path, write):
    top = tmp_path / "table" / "data" / f"_write={write}"
    return {p.name for p in top.iterdir() if p.name.startswith("_bucket=")} if top.exists() else set()


def test_upsert_writes_changed_buckets_only(spark, tmp_path):
    table = bucketed(spark, tmp_path)
    assert table.read().count() == 0 and table.versions() == []
    first = table.upsert(rows(spark, [(i, f"e{i}", 0, "x") for i in range(200)]), ["name", "n"], 0, as_of=10)
    assert (first["found"], first["created"], first["updated"], first["skipped"], first["rejected"]) == (200, 200, 0, 0, 0)
    assert len(written(tmp_path, 0)) == 16
    counts = table.upsert(rows(spark, [(3, "e3", 0, "other image"), (4, "new name", 0, "y"), (None, "no key", 0, "z"), (999, "e999", 1, None)]), ["name", "n"], 5, as_of=20)
    assert (counts["found"], counts["created"], counts["updated"], counts["skipped"], counts["rejected"]) == (4, 1, 1, 1, 1)
    assert 1 <= len(written(tmp_path, 5)) <= 2
    now = held(table)
    assert len(now) == 201 and now[3] == ("e3", 0, "x", 10) and now[4] == ("new name", 0, "y", 10) and now[999] == ("e999", 1, None, 20)
    assert held(table, before=5)[4] == ("e4", 0, "x", 10)
    assert {(r.external_id, r._status) for r in table.changes(5).collect()} == {(4, "updated"), (999, "created")}
    # nothing changes: a version without data
    assert table.upsert(rows(spark, [(4, "new name", 0, "q")]), ["name", "n"], 6)["skipped"] == 1
    assert written(tmp_path, 6) == set() and table.versions() == [0, 5, 6] and held(table) == now
    # repeated under a published number: the logged counters, nothing else
    assert table.upsert(rows(spark, [(4, "different", 0, "q")]), ["name", "n"], 5) == counts and held(table) == now
    assert [(r.version, r.created) for r in table.log().orderBy("version").collect()] == [(0, 200), (5, 1), (6, 0)]


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    table = bucketed(spark, tmp_path, 4)
    table.upsert(rows(spark, [(i, "a", 0, "x") for i in range(50)]), ["name"], 1)
    before = held(table)
    change = rows(spark, [(i, "b", 0, "x") for i in range(25)] + [(100, "c", 0, "x")])
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            table.upsert(change, ["name"], 2)
    assert held(table) == before and table.versions() == [1]
    counts = table.upsert(change, ["name"], 2)
    assert (counts["created"], counts["updated"], counts["skipped"]) == (1, 25, 0)  # not told against its own half write
    assert Counter(v[0] for v in held(table).values()) == {"a": 25, "b": 25, "c": 1}


def test_vacuum_keeps_what_newer_versions_need(spark, tmp_path):
    table = bucketed(spark, tmp_path, 4)
    for version in range(5):
        table.upsert(rows(spark, [(i, f"v{version}", 0, "x") for i in range(40) if version == 0 or i == 7]), ["name"], version)
    now = held(table)
    assert table.vacuum(2) == [1, 2]
    assert held(table) == now and table.versions() == [3, 4] and table.log().count() == 5
    assert {v[0] for v in now.values()} == {"v0", "v4"}


def test_restarted_stream_counts_as_if_nothing_had_happened(spark, tmp_path, monkeypatch):
    schema = "external_id long, name string, n int, image string, seen int"
    for k in range(3):
        rows(spark, [(i, f"e{i % (5 + k)}", k, "x", j) for j, i in enumerate([*range(k * 10, k * 10 + 30), k * 10])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(table, checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = ingestion.ingest(stream, table, checkpoint, ["seen"], ["name"])
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    steady, torn = bucketed(spark, tmp_path, name="steady"), bucketed(spark, tmp_path, name="torn")
    run(steady, folder(tmp_path, "cp1"))
    plain, calls = BucketedTable.publish, []

    def publish(self, version, told):
        calls.append(version)
        if calls == [0, 1]:
            raise OSError("killed")
        plain(self, version, told)

    monkeypatch.setattr(BucketedTable, "publish", publish)
    with pytest.raises(Exception, match="killed"):
        run(torn, folder(tmp_path, "cp2"))
    assert torn.versions() == [0]
    run(torn, folder(tmp_path, "cp2"))
    assert calls == [0, 1, 1, 2]
    assert held(torn) == held(steady)
    assert sorted(torn.log().collect()) == sorted(steady.log().collect())
    # a batch that was published but not committed to the checkpoint changes nothing
    for name in (".2.crc", "2"):
        os.remove(tmp_path / "cp2" / "commits" / name)
    run(torn, folder(tmp_path, "cp2"))
    assert calls == [0, 1, 1, 2] and held(torn) == held(steady)


class Pages(readers.PagedEvents):
    """Seven events a page, of which every fifth has no store."""

    def load_page(self, page):
        in_task = TaskContext.get() is not None
        store = {"id": page, "name": f"Store {page % 3}", "city": "Town", "state": "TX", "country": "US", "latitude": 30, "longitude": -97.5}
        return [{"id": i, "name": f"Nexus Night {i}", "description": f"in task {in_task}", "start_datetime": f"2024-03-{page:02d}T10:00:00", "cost_in_cents": 500, "currency": "USD", "full_address": "1 Road, Town, TX 78701, US", "store": store if i % 5 else None} for i in range((page - 1) * 7, min(page * 7, 45))]


def test_paged_source_and_stream(spark, tmp_path):
    spark.dataSource.register(Pages)
    options = {"total": "45", "page_size": "7"}
    whole = spark.read.format("paged_events").options(**options).load()
    assert whole.count() == 45 and whole.rdd.getNumPartitions() == 7
    assert {r.description for r in whole.select("description").distinct().collect()} == {"in task True"}
    assert whole.where("store is null").count() == 9 and whole.selectExpr("max(store.latitude)").first()[0] == 30.0
    sizes = []
    stream = spark.readStream.format("paged_events").options(pages_per_batch="3", **options).load()
    run = stream.writeStream.foreachBatch(lambda df, n: sizes.append((df.count(), df.select("description").first()[0] if df.count() else None))).option("checkpointLocation", str(tmp_path)).start()
    run.processAllAvailable()
    run.stop()
    assert [x for x in sizes if x[0]] == [(21, "in task True"), (21, "in task True"), (3, "in task True")]


def test_pages_to_the_table_in_one_stream(spark, tmp_path):
    spark.dataSource.register(Pages)
    templates = spark.createDataFrame([("T", "plain")], "id string, name string")
    options = {"total": "45", "page_size": "7"}
    events = merge.canonical_events(spark.read.format("paged_events").options(**options).load(), templates)
    table = BucketedTable(spark, folder(tmp_path, "table"), "external_id", events.schema, 8)

    def prepare(raw):
        own = merge.canonical_events(raw, templates)
        places = raw.select(F.col("id").cast("string").alias("external_id"), "page", "position")
        return own.join(places, "external_id")

    def run(total):
        stream = ingestion.page_stream(spark, table, pages_per_batch="2", page_size="7", total=total)
        query = ingestion.ingest(stream, table, folder(tmp_path, "cp"), ["page", "position"], COMPARED_EVENT, prepare, store="shop_name", page="page")
        query.processAllAvailable()
        query.stop()

    run("28")  # four pages, then more appear and the stream starts again
    assert [(r.found, r.created, r.last_page) for r in table.log().where("found > 0").orderBy("version").collect()] == [(14, 14, 2), (14, 14, 4)]
    run("45")
    assert [(r.found, r.created, r.last_page) for r in table.log().where("found > 0").orderBy("version").collect()] == [(14, 14, 2), (14, 14, 4), (14, 14, 6), (3, 3, 7)]
    assert sorted(map(str, table.read().collect())) == sorted(map(str, events.collect()))
    told = ingestion.run_row(table, "a", "b").first()
    assert (told.found, told.created, told.updated, told.skipped, told.pages, told.skip_rate) == (45, 45, 0, 0, 7, 0)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


SEEN = "external_id long, name string, n int, seen timestamp"


def drop(spark, tmp_path, k, values):
    spark.createDataFrame(values, "external_id long, name string, n int, at string").selectExpr("external_id", "name", "n", "timestamp(at) seen").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))


def by_state(spark, tmp_path, name="out"):
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = ingestion.latest_by_state(stream, "external_id", "seen", ["name"], days=90)
    run = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return Counter((r.key, r.status) for r in spark.read.schema("key string, status string, row string").parquet(str(tmp_path / name)).collect())


def test_keyed_state_equals_merges_and_expires(rocks, tmp_path):
    spark = rocks
    drop(spark, tmp_path, 1, [(1, "a", 0, "2024-01-01 00:00:00"), (2, "b", 0, "2024-01-01 00:00:00"), (1, "a2", 0, "2024-01-01 00:30:00"), (None, "z", 0, "2024-01-01 00:30:00")])
    drop(spark, tmp_path, 2, [(1, "a2", 5, "2024-01-02 00:00:00"), (2, "b2", 0, "2024-01-02 00:00:00"), (3, None, 0, "2024-01-02 00:00:00")])
    got = by_state(spark, tmp_path)
    want = {("1", "created"): 1, ("2", "created"): 1, ("1", "skipped"): 1, ("2", "updated"): 1, ("3", "created"): 1}
    assert got == want
    stored = spark.createDataFrame([], "external_id long, name string, n int")
    batches = []
    for k in (1, 2):
        last = merge.last_of_batch(spark.read.parquet(str(tmp_path / "in" / f"{k}")), "external_id", ["seen"]).drop("seen")
        post = merge.merge(stored, last, "external_id", ["name"]).collect()
        batches += [(str(r.external_id), r._status) for r in post if r._status != "kept"]
        stored = spark.createDataFrame(post).drop("_status")
    assert Counter(batches) == want
    # started again from its checkpoint: 91 days later all keys are dropped, and key 1 is new when it returns
    drop(spark, tmp_path, 3, [(9, "late comer", 0, "2024-04-05 00:00:00")])
    drop(spark, tmp_path, 4, [(9, "late comer", 0, "2024-04-05 03:00:00")])
    drop(spark, tmp_path, 5, [(1, "a2", 5, "2024-04-05 04:00:00")])
    got = by_state(spark, tmp_path) - Counter(want)
    assert got == {("9", "created"): 1, ("9", "skipped"): 1, ("1", "expired"): 1, ("2", "expired"): 1, ("3", "expired"): 1, ("1", "created"): 1}


def test_listener_publishes_counters_of_each_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(s,) for s in ["created"] * (k + 1) + ["skipped"]], "_status string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    listener = ingestion.MetricsToTable(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("_status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        run = sinks.rate_metrics(stream, "events").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        failing = stream.select(F.raise_error(F.lit("broken page")).alias("x")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken page"):
            failing.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    got = {r.batch: r.counters for r in ingestion.published(spark, str(tmp_path / "metrics")).where("name = 'events'").collect()}
    assert [(got[k]["found"], got[k]["created"], got[k]["skipped"]) for k in range(3)] == [(2, 1, 1), (3, 2, 1), (4, 3, 1)]
    assert spark.read.parquet(str(tmp_path / "metrics")).where("error is not null").count() == 1
