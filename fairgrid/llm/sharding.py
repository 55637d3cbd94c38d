"""Sharding: balanced label propagation over links of equal text, in DataFrames only.

Documents with equal texts are linked. All members of such a group have the same neighbours, so labels are kept as
cells (group, shard, members). Groups with a thousandth of all rows or more, a thousand at most, are seeds: they are
placed largest first where they fit best, and split over the emptiest shards only where none has room for the whole.
The other groups start where a hash deals their members. Each round, members move to the shard where most of their
neighbours are, accepted in order of gain, and shards may hold more than their quota meanwhile; rounds end when the
number of cut links stops falling. The excess is then given back in whole groups, laid one after another into what is
free, so that no more groups of this kind are cut than there are shards. Documents without links fill every shard to
its exact quota.
"""

from __future__ import annotations

import json
from bisect import insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.llm.common import documents, materialise, positions, rank_buckets

#: Moves of equal gain are accepted in this many hash classes.
LANES = 64
#: While labels move, a shard may hold its quota and this part of it more.
SLACK = 4


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's ``rows``, without Python on the executors."""
    told = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(told).alias("_t")).select("_t.*")


def _place(groups: list[tuple[str, int]], room: list[int]) -> list[dict]:
    """Cells of ``groups`` (link, members), largest first, each in the shard that it fits best; ``room`` shrinks.

    What fits nowhere fills the shard with most room and goes on with the rest.
    """
    cells = []
    free = sorted((n, shard) for shard, n in enumerate(room) if n)
    for link, members in sorted(groups, key=lambda x: (-x[1], x[0])):
        while members and free:
            at = next((k for k, (n, _) in enumerate(free) if n >= members), len(free) - 1)
            n, shard = free.pop(at)
            part = min(n, members)
            cells.append({"link": link, "shard": shard, "n": part})
            members -= part
            room[shard] -= part
            if n > part:
                insort(free, (n - part, shard))
    return cells


def _ends(sizes: list[int]) -> list[int]:
    return [sum(sizes[: k + 1]) for k in range(len(sizes))]


def _shard_of(place: Column, ends: list[int]) -> Column:
    """The shard whose span of ``ends`` holds ``place``."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)).cast("int")


def _offsets(cells: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add ``_start``: the members of cells before each one among those with its ``keys``."""
    dealt = cells.withColumn("_bucket", F.pmod(F.xxhash64("link", F.lit(3)), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by).agg(F.sum("n").alias("_sum")).withColumn("_first", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by).orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(starts, by).withColumn("_start", F.col("_first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("_bucket", "_first")


def _cells(members: DataFrame, room: list[int]) -> DataFrame:
    """Start labels: each member goes where the hash of its doc_id says, in proportion to the shards' room."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(1, sum(room))))
    return members.groupBy("link", _shard_of(place, _ends(room)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _round(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """One round of label propagation: ``cells`` with the accepted moves made.

    Members of a cell move to the shard under its limit where most of their neighbours are, if more are there than
    here. Moves are accepted class by class, most neighbours first, until the limit is reached.
    """
    used = cells.groupBy("shard").agg(F.sum("n").alias("_used"))  # a row for each shard
    room = limits.join(F.broadcast(used), "shard", "left").select("shard", (F.col("limit") - F.coalesce("_used", F.lit(0))).alias("_room"))
    order = F.struct("n", F.xxhash64("link", "shard").alias("h"), "shard")
    best = F.max(F.when(F.col("_room") > 0, order)).over(Window.partitionBy("link"))
    wished = cells.join(F.broadcast(room), "shard").withColumn("_best", best)
    moves = wished.select("link", "shard", "n", F.coalesce(F.col("_best") > order, F.lit(False)).alias("_moves"), F.col("_best.shard").alias("_to"), F.col("_best.n").alias("_most"))
    moves = moves.withColumn("_class", F.floor(F.log2(F.greatest("_most", F.lit(1)))).cast("int")).withColumn("_lane", F.pmod(F.xxhash64("link"), F.lit(LANES)).cast("int"))
    in_order = Window.partitionBy("_to").orderBy(F.desc("_class"), "_lane").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = moves.where("_moves").groupBy("_to", "_class", "_lane").agg(F.sum("n").alias("_wanted")).withColumn("_upto", F.sum("_wanted").over(in_order))
    granted = wanted.join(F.broadcast(room.withColumnRenamed("shard", "_to")), "_to").where(F.col("_upto") - F.col("_wanted") < F.col("_room"))
    granted = granted.select("_to", "_class", "_lane", F.lit(True).alias("_granted"))  # shards, classes and lanes: a few thousand rows
    told = moves.join(F.broadcast(granted), ["_to", "_class", "_lane"], "left")
    shard = F.when(F.col("_moves") & F.col("_granted"), F.col("_to")).otherwise(F.col("shard"))
    return told.groupBy("link", shard.alias("shard")).agg(F.sum("n").alias("n"))


def _propagate(cells: DataFrame, room: list[int]) -> DataFrame:
    """Rounds of label propagation until the number of cut links stops falling."""
    limits = _table(cells.sparkSession, [{"shard": k, "limit": n + -(-n // SLACK)} for k, n in enumerate(room)], "shard int, limit long")
    kept = -1
    while True:
        # links within shards; each round that moves anything adds to them
        now = cells.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))).first()[0]
        if now <= kept:
            return cells
        kept = now
        cells = materialise(_round(cells, limits), "shard-cells")


def _give_back(cells: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """``cells`` within ``room``: groups beyond it, and groups still cut, are laid whole into what is free.

    The few that would lie across the end of a shard's room are placed like the seeds.
    """
    spark = cells.sparkSession
    by_shard = lambda df: {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("n")).collect()}
    groups = materialise(cells.groupBy("link").agg(F.count(F.lit(1)).alias("_shards"), F.min("shard").alias("shard"), F.sum("n").alias("n")), "shard-groups")
    whole = _offsets(groups.where("_shards = 1"), ["shard"], buckets)
    limits = _table(spark, [{"shard": k, "limit": n} for k, n in enumerate(room)], "shard int, limit long")
    seen = materialise(whole.join(F.broadcast(limits), "shard").select("link", "shard", "n", (F.col("_start") + F.col("n") <= F.col("limit")).alias("_stays")), "shard-whole")
    stay = seen.where("_stays").select("link", "shard", "n")
    stayed = by_shard(stay)
    holes = [n - stayed.get(k, 0) for k, n in enumerate(room)]
    ends = _ends(holes)
    pool = materialise(groups.where("_shards > 1").select("link", "n").unionByName(seen.where("not _stays").select("link", "n")).withColumn("_all", F.lit(0)), "shard-loose")
    last = _shard_of(F.col("_start") + F.col("n") - 1, ends)
    laid = materialise(_offsets(pool, ["_all"], buckets).select("link", "n", _shard_of(F.col("_start"), ends).alias("shard"), last.alias("_last")), "shard-laid")
    inside = laid.where("shard = _last").select("link", "shard", "n")
    filled = by_shard(inside)
    across = [(r[0], r[1]) for r in laid.where("shard < _last").select("link", "n").collect()]  # fewer than the shards
    split = _place(across, [n - filled.get(k, 0) for k, n in enumerate(holes)])
    return stay.unionByName(inside).unionByName(_table(spark, split, "link string, shard int, n long"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the law is ``rows``.

    Shards differ by at most one row. ``size`` is the text's UTF-8 bytes plus 1 (null: 1), null texts count as
    empty and are linked with each other. Cut links are minimised within the quotas: a group larger than a
    shard's quota is split. Repeated rows are rows of their own; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("link"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = materialise(rows, "shard-rows")
    total = base.count()
    buckets = rank_buckets(total)
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("quota"))

    sizes = base.groupBy("link").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1")
    # groups of a thousandth of all rows are few enough to broadcast, so no join key is hot
    large = [(r[0], r[1]) for r in sizes.where(F.col("_members") * 1000 >= total).collect()]
    hot = _table(spark, [{"link": link} for link, _ in large], "link string").withColumn("_hot", F.lit(True))
    marked = base.join(F.broadcast(hot), "link", "left")
    linked = marked.where("_hot").drop("_hot").unionByName(marked.where("_hot is null").drop("_hot").join(sizes.select("link"), "link", "left_semi"))
    linked = materialise(linked, "shard-linked")
    room = [total // shards + (k < total % shards) for k in range(shards)]
    seeds = _table(spark, _place(large, room), "link string, shard int, n long")
    light = linked.join(F.broadcast(hot), "link", "left_anti")
    cells = _propagate(materialise(_cells(light, room), "shard-cells"), room)
    cells = materialise(seeds.unionByName(_give_back(cells, room, buckets)), "shard-cells")

    # members of a group are alike: their rank in the group picks the cell
    ends = Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = cells.withColumn("_to", F.sum("n").over(ends)).withColumn("_from", F.col("_to") - F.col("n"))
    spans = spans.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "shard"))).alias("_spans"))  # at most one entry a shard
    ranked = positions(linked.select("link", "_row"), ["link"], ["_row"], "_rank", buckets)
    marked = ranked.join(F.broadcast(hot), "link", "left")
    hot_spans = spans.join(F.broadcast(hot.select("link")), "link", "left_semi")
    placed = marked.where("_hot").join(F.broadcast(hot_spans), "link").unionByName(marked.where("_hot is null").join(spans, "link"))
    own = F.element_at(F.filter("_spans", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"])), 1)["shard"]
    wished = base.join(placed.select("_row", own.alias("_label")), "_row", "left")
    wished = materialise(wished.select("doc_id", "size", "text_crc32", "_row", F.coalesce("_label", F.lit(-1)).alias("_label")), "shard-wished")

    # rows beyond a shard's quota and rows without links fill what is free
    slots = materialise(positions(wished, ["_label"], ["_row"], "_place", buckets), "shard-slots")
    taken = slots.groupBy("_label").count().where("_label >= 0")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over the shards, ``shards`` rows in all
    free = quota.join(F.broadcast(taken.select(F.col("_label").alias("shard"), "count")), "shard", "left").withColumn("_used", F.least(F.coalesce("count", F.lit(0)), F.col("quota")))
    free = free.withColumn("_open", F.col("quota") - F.col("_used")).withColumn("_first", F.coalesce(F.sum("_open").over(before), F.lit(0)))
    limits = F.broadcast(quota.select(F.col("shard").alias("_label"), "quota"))
    seen = slots.join(limits, "_label", "left")
    stay = seen.where("_label >= 0 and _place < quota").select("doc_id", "size", "text_crc32", F.col("_label").alias("shard"), F.col("_place").alias("slot"))
    pool = seen.where("_label < 0 or _place >= quota").select("doc_id", "size", "text_crc32", "_row", F.lit(0).alias("_all"))
    pool = positions(materialise(pool, "shard-pool"), ["_all"], ["_row"], "_k", buckets)
    holes = F.broadcast(free.where("_open > 0").select("shard", "_used", "_first", "_open"))
    filled = pool.join(holes, (F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_first") + F.col("_open")))
    filled = filled.select("doc_id", "size", "text_crc32", "shard", (F.col("_used") + F.col("_k") - F.col("_first")).alias("slot"))
    out = stay.unionByName(filled)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all ``documents`` into shards 0 to 7."""
    return shard_documents(documents(spark, sf_dir), shards=8)
