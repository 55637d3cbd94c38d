"""The prefix trie of conversations by an external mergesort whose runs carry longest common prefixes (LCPs).

A turn is a 16-byte mark (SHA-256 of role and text, cut), a conversation the sequence of its turns' marks. Tasks sort
bounded runs of conversations and write them front-coded in blocks: each conversation with its LCP, in turns, to the
one before it, and only the marks beyond. Splitters, fixed from a sample, part the order of (marks, conv_id); a part
is merged from its blocks by a loser tree that compares LCPs first and marks only beyond them. Blocks come in the
order in which the merge will want them, so it holds one block a run. The merged stream drives a stack of the open
path: what the next conversation doesn't share is finished and emitted.

Ids are part of the order, so one conversation repeated any number of times is shared out over parts. A node whose
conversations lie in several parts gives a partial row in each. The LCPs between the ends of neighbouring parts tell
which nodes these are and where each is first and last seen, so that all counts just add up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.llm.common import materialise

#: Bytes of a turn's mark.
MARK = 16
#: Bytes of marks in a part, and the most parts; a part is streamed, so its size bounds no memory.
PART_BYTES, MOST_PARTS = 1 << 18, 4096
#: Conversations and bytes of a run that is sorted in memory, and conversations of a block.
RUN_ROWS, RUN_BYTES, BLOCK_ROWS = 50_000, 32 << 20, 512
#: Children that wait for their parent's id on the open path, and ids in a part of a node's list of ends.
WAITING, END_IDS = 20_000, 20_000
#: Nodes looked up as parents that are broadcast, about 50 bytes each.
BROADCAST_NODES = 200_000

FINISHED, PARTIAL, ORPHAN, PARENT, ENDS = range(5)
BLOCKS = "part int, run long, need_key binary, need_id long, first_key binary, first_id long, last_key binary, last_id long, ids array<long>, lcps array<int>, marks binary, lengths array<int>, sizes array<int>"
NODES = "kind int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first_id long, list string"
NAMES = [x.split()[0] for x in NODES.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(mark, size)``, size the text's UTF-8 bytes.

    Order is by turn, null first, then by role and mark. Null roles and texts become empty; rows with a null conv_id
    take no part; repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * MARK)
    order = [F.col("turn").isNotNull().alias("told"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role")]
    told = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(*order, mark.alias("mark"), F.octet_length(text).alias("size")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size")))
    return told.groupBy("conv_id").agg(ordered.alias("turns"))


def common_turns(a: bytes, b: bytes, since: int = 0) -> int:
    """The LCP of two sequences of marks that share their first ``since`` turns."""
    start, stop = since * MARK, min(len(a), len(b))
    x = int.from_bytes(a[start:stop]) ^ int.from_bytes(b[start:stop])
    return (stop - (x.bit_length() + 7) // 8) // MARK if x else stop // MARK


def sorted_run(rows: list[tuple[bytes, int, list[int]]], run: int, splitters: list[tuple[bytes, int]], block_rows: int) -> Iterator[tuple]:
    """Sort one run and yield its blocks, each within one part."""
    rows.sort(key=lambda r: r[:2])
    at = 0
    places = [bisect_right(splitters, r[:2]) for r in rows]
    while at < len(rows):
        part = places[at]
        stop = min(at + block_rows, bisect_right(places, part, at))
        need = rows[at - 1][:2] if at and places[at - 1] == part else (None, None)
        lcps, marks, sizes, before = [], [], [], b""
        for key, _, own in rows[at:stop]:
            lcp = common_turns(before, key)
            lcps.append(lcp)
            marks.append(key[lcp * MARK :])
            sizes += own[lcp:]
            before = key
        inside = rows[at:stop]
        yield (part, run, *need, *inside[0][:2], *inside[-1][:2], [r[1] for r in inside], lcps, b"".join(marks), [len(r[2]) for r in inside], sizes)
        at = stop


class Source:
    """A run within a part: its current conversation, read from front-coded blocks."""

    def __init__(self, block: dict):
        self.run = block["run"]
        self.key, self.sizes = b"", []
        self.load(block)

    def load(self, block: dict) -> None:
        self.block, self.place, self.mark_at, self.size_at = block, -1, 0, 0

    def step(self) -> int | None:
        """Go to the block's next conversation and return its LCP to the one before, None at the block's end."""
        self.place += 1
        block = self.block
        if self.place == len(block["ids"]):
            return None
        lcp, length = block["lcps"][self.place], block["lengths"][self.place]
        before, new = (self.key, length - lcp) if self.place else (b"", length)
        suffix = block["marks"][self.mark_at : self.mark_at + new * MARK]
        sizes = block["sizes"][self.size_at : self.size_at + new]
        self.mark_at, self.size_at = self.mark_at + new * MARK, self.size_at + new
        old = self.key
        self.key, self.sizes, self.id = before[: lcp * MARK] + suffix, self.sizes[:lcp] + sizes, block["ids"][self.place]
        return lcp if self.place else common_turns(old, self.key)  # a block starts anew


def merged(blocks: Iterator[dict]) -> Iterator[tuple[bytes, int, list[int], int]]:
    """``(key, id, sizes, lcp)`` of a part's conversations in order, with the LCP to the one before.

    ``blocks`` gives the runs' first blocks and then every other in the order in which the one before it ends. Losers
    keep their LCP to the conversation that beat them; on the path of the last winner that is the last one given out,
    so a longer LCP wins without a look at the marks, and equal ones are compared only beyond.
    """
    blocks = iter(blocks)
    sources, ahead = [], next(blocks, None)
    while ahead is not None and ahead["need_id"] is None:
        sources.append(Source(ahead))
        ahead = next(blocks, None)
    n = len(sources)
    lcp = [0] * n
    open_ = [s.step() is not None for s in sources]
    losers = [-1] * max(1, n)

    def beats(a: int, b: int) -> bool:
        """Whether source a goes before b; the loser's LCP becomes the one to the winner."""
        if not open_[a] or not open_[b]:
            return open_[a]
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = sources[a], sources[b]
        shared = common_turns(x.key, y.key, lcp[a])
        cut = shared * MARK
        first = x.id < y.id if len(x.key) == len(y.key) == cut else x.key[cut : cut + MARK] < y.key[cut : cut + MARK]
        lcp[b if first else a] = shared
        return first

    def play(node: int) -> int:
        if node >= n:
            return node - n
        a, b = play(2 * node), play(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        losers[node] = lost
        return won

    winner = play(1) if n else -1
    while n and open_[winner]:
        own = sources[winner]
        yield own.key, own.id, own.sizes, lcp[winner]
        got, last = own.step(), own.id
        if got is None and ahead is not None and ahead["run"] == own.run and ahead["need_id"] == last:
            own.load(ahead)
            ahead = next(blocks, None)
            got = own.step()
        if got is None:
            open_[winner] = False
        else:
            lcp[winner] = got
        node = (winner + n) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


class Frame:
    """An open node: ``prior`` if an earlier part has seen it, ``edge`` if another part has it too."""

    __slots__ = ("depth", "edge", "ends", "has_child", "key", "late", "leaves", "least", "listed", "n_children", "n_convs", "prior", "saved", "size", "waiting")

    def __init__(self, depth: int, key: bytes, size: int, prior: bool):
        self.depth, self.key, self.size, self.prior, self.edge = depth, key, size, prior, prior
        self.n_convs = self.n_children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.has_child = self.late = self.listed = False
        self.ends: list[int] = []
        self.waiting: list[list] = []


class OpenPath:
    """The stack of open nodes of one part; ``out`` takes finished rows."""

    def __init__(self, before: int, after: int):
        """``before`` and ``after`` are the LCPs to the neighbouring parts' nearest conversations, -1 without one."""
        self.before, self.after = before, after
        self.frames: list[Frame] = []
        self.out: list[tuple] = []
        self.n_waiting = 0

    def add(self, key: bytes, conv_id: int, sizes: list[int], lcp: int) -> None:
        first = not self.frames
        if first:
            self.frames.append(Frame(0, bytes(MARK), 0, self.before >= 0))
        while len(self.frames) - 1 > lcp:
            self._finish(False)
        for depth in range(len(self.frames), len(sizes) + 1):
            chain = hashlib.sha256(self.frames[-1].key + key[(depth - 1) * MARK : depth * MARK]).digest()[:MARK]
            self.frames.append(Frame(depth, chain, sizes[depth - 1], first and depth <= self.before))
        top = self.frames[-1]
        top.n_convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)
        if len(top.ends) == END_IDS:
            self._list(top)

    def end(self) -> None:
        while self.frames:
            depth = self.frames[-1].depth
            self.frames[-1].edge |= depth <= self.after
            self._finish(depth <= self.after)

    def _list(self, frame: Frame) -> None:
        if frame.ends:
            self.out.append((ENDS, frame.key, *[None] * 9, frame.ends[0], ",".join(map(str, frame.ends))))
            frame.ends, frame.listed = [], True

    def _release(self, frame: Frame, kind: int, parent: int | None) -> None:
        """Give out the children that wait in a frame."""
        for row in frame.waiting:
            row[0], row[5] = kind, parent
            self.out.append(tuple(row))
        self.n_waiting -= len(frame.waiting)
        frame.waiting = []

    def _finish(self, goes_on: bool) -> None:
        frame = self.frames.pop()
        parent = self.frames[-1] if self.frames else None
        if not frame.has_child and not goes_on:
            frame.leaves = 1
        frame.saved += (frame.n_convs - (not frame.prior)) * frame.size
        if frame.edge:
            self._list(frame)
        self._release(frame, ORPHAN if frame.edge else FINISHED, None if frame.edge else frame.least)
        if frame.late and not frame.edge:
            self.out.append((PARENT, frame.key, None, frame.depth, frame.least, *[None] * 8))
        partial = frame.edge or frame.listed
        if partial:
            self._list(frame)
        sha = None if partial else hashlib.sha256(",".join(map(str, frame.ends)).encode()).hexdigest() if frame.ends else NO_ENDS
        row = [PARTIAL if partial else FINISHED, frame.key, parent.key if parent else None, frame.depth, frame.least, None, frame.n_convs, frame.n_children, frame.leaves, frame.saved, sha, None, None]
        if parent is None:
            self.out.append(tuple(row))
            return
        parent.n_convs += frame.n_convs
        parent.least = frame.least if parent.least is None else min(parent.least, frame.least)
        parent.leaves += frame.leaves
        parent.saved += frame.saved
        parent.n_children += not frame.prior
        parent.has_child = True
        if partial:
            parent.late = True
            self.out.append(tuple(row))
            return
        parent.waiting.append(row)
        self.n_waiting += 1
        if self.n_waiting > WAITING:
            most = max(self.frames, key=lambda f: len(f.waiting))
            most.late = True
            self._release(most, ORPHAN, None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def trie(conversations: DataFrame, part_bytes: int = PART_BYTES, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turns`` as :func:`sequences` gives them): a row for each node.

    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, (n_convs - 1) times the
    bytes of the node's last text), ``ends_sha256`` (of the ids that end there, ascending, joined by commas).

    Equal conversations share all their nodes; one without turns is a member of the root alone. An empty table has
    no nodes, not even a root. A conversation is one record of 20 bytes a turn, however long, and the open path holds
    a frame for each of its turns; the ids of one node's ends are hashed in order, by one task, as SHA-256 demands,
    but come to it as lists of END_IDS ids. Ids are taken to be unique; other columns are not read.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    convs = materialise(conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "conversations")
    spark = convs.sparkSession
    total, size = convs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key") + 8), F.lit(0))).first()
    parts = max(1, min(MOST_PARTS, int(size // part_bytes)))
    share = min(1 << 20, (1 << 20) * 16 * parts // max(1, total) + 1)
    picked = convs.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < F.lit(share)).select(F.substring("key", 1, 1024), "conv_id")
    sample = sorted((bytes(k), i) for k, i in picked.limit(32 * MOST_PARTS).collect()) if parts > 1 else []  # about 16 a part
    splitters = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    block_schema, node_schema = _arrow(BLOCKS), _arrow(NODES)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32
        held: list[tuple[bytes, int, list[int]]] = []
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, weight, run
            told: list[tuple] = []
            for block in sorted_run(held, run, splitters, block_rows):
                told.append(block)
                if len(told) == 64:
                    yield _batch(told, block_schema)
                    told = []
            yield _batch(told, block_schema)
            held, weight, run = [], 0, run + 1

        for batch in batches:
            for conv_id, marks, sizes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((marks, conv_id, sizes))
                weight += len(marks)
                if len(held) >= run_rows or weight >= RUN_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    blocks = materialise(convs.select("conv_id", "key", "sizes").mapInArrow(sort, BLOCKS), "trie-runs")

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else common_turns(x, y) for x, y in zip(a, b, strict=True)])

    ends = blocks.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("first"), F.max(F.struct("last_key", "last_id")).alias("last"))
    order = Window.orderBy("part")  # a row for each part, MOST_PARTS at most
    near = ends.select("part", "first.first_key", F.lag("last.last_key").over(order).alias("last_key")).select("part", shared("last_key", "first_key").alias("lcp")).orderBy("part").collect()
    gaps = [r["lcp"] for r in near] + [-1]
    around = {r["part"]: (gaps[k], gaps[k + 1]) for k, r in enumerate(near)}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(_rows(batches), key=lambda b: b["part"]):
            path = OpenPath(*around[part])
            for conversation in merged(own):
                path.add(*conversation)
                if len(path.out) >= 10_000:
                    yield _batch(path.out, node_schema)
                    path.out = []
            path.end()
            yield _batch(path.out, node_schema)

    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part", "need_key", "need_id", "run")
    nodes = materialise(dealt.mapInArrow(merge, NODES), "trie-nodes")
    return _whole(spark, nodes)


def _whole(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Add up the rows of nodes that lie in several parts, and look up the parents that weren't known in time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for row in _rows(batches):
            if row["key"] != key:
                if state:
                    yield told(key, state)
                key, state = row["key"], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["list"].encode())
        if state:
            yield told(key, state)

    def told(key: bytes, state: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    listed = nodes.where(F.col("kind") == ENDS).select("key", "first_id", "list").repartition("key").sortWithinPartitions("key", "first_id")
    digests = listed.mapInArrow(digest, "key binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    added = nodes.where(F.col("kind") == PARTIAL).groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    added = materialise(added.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie-edges")
    parents = materialise(added.select("key", "conv_id").unionByName(nodes.where(F.col("kind") == PARENT).select("key", "conv_id")), "trie-parents").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    orphans = added.unionByName(nodes.where(F.col("kind") == ORPHAN).select(added.columns))
    found = orphans.join(F.broadcast(parents) if parents.count() <= BROADCAST_NODES else parents, "parent_key", "left")
    return nodes.where(F.col("kind") == FINISHED).select(*RESULT).unionByName(found.select(*RESULT))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The contract's conversations: each starts with the first h turns of ``conv_id - conv_id % group``, its own following from turn h.

    h is the crc32 of the decimal id modulo ``most``. ``conversations`` has ``conv_id, turns``.
    """
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1)), ignorenulls=True).over(Window.partitionBy("base"))  # of 2 * group - 1 conversations at most
    own: Column = F.slice("turns", F.col("h") + 1, F.size("turns"))
    shared = conversations.withColumn("base", base).withColumn("first", first).withColumn("h", taken)
    return shared.select("conv_id", F.when(F.col("first").isNull(), own).otherwise(F.concat(F.slice("first", 1, F.col("h")), own)).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: the trie of all rebuilt ``conversations``."""
    return trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = """
WITH own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL GROUP BY conv_id),
cuts AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM cuts c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (SELECT conv_id, depth, turns[1:depth] AS turns, depth = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
marked AS (SELECT *, dense_rank() OVER (ORDER BY depth, turns) AS node FROM prefixes),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(turns)[any_value(depth)].text), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM marked GROUP BY node),
edges AS (SELECT DISTINCT c.node, p.node AS parent FROM marked c JOIN marked p ON c.conv_id = p.conv_id AND c.depth = p.depth + 1),
below AS (SELECT DISTINCT a.node, d.node AS other FROM marked a JOIN marked d ON a.conv_id = d.conv_id AND d.depth >= a.depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent),
sums AS (
  SELECT b.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens FROM below b JOIN nodes n ON n.node = b.other LEFT JOIN children c ON c.node = b.other GROUP BY b.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN edges e USING (node) LEFT JOIN nodes p ON p.node = e.parent"""
