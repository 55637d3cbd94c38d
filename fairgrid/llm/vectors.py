"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

Vectors are lengthened by one coordinate to equal norms, so that the largest inner product is the least distance. The
tree is fitted on a bounded sample and then every row is dealt to its leaf; the few vectors that are much longer than
the others would flatten them to one point, so they lie in a leaf of their own, which every query visits. A query walks the tree with a priority
queue, nearest bins first, for as many leaves as a calibration found to reach the recall asked for. Leaves are cut
into blocks of bounded size, so one vector repeated any number of times is shared out over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.llm.common import materialise

#: Rows of a leaf that are compared in one group.
BLOCK_ROWS = 4096
#: Queries of a leaf that are compared in one group.
QUERY_ROWS = 1024
#: Leaves that a query visits first, to know how near a row must be for the others to tell it.
FIRST = 4
#: Vectors longer than this many times the median, and than all but a thousandth, have a leaf of their own.
LONG = 4


@dataclass
class Node:
    """Centres of the children; ``children`` are nodes or leaf numbers."""

    centres: np.ndarray
    children: list = field(default_factory=list)


@dataclass
class Tree:
    """A fitted tree; ``reach`` is the largest norm of the rows it was fitted for."""

    root: Node | int
    leaves: int
    reach: float
    dimensions: int

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        """With the coordinate that makes norms equal."""
        rest = np.sqrt(np.maximum(self.reach**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        return np.column_stack([vectors, rest])

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        points = self.lengthened(vectors)
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            near = _nearest(points[rows], node.centres)
            todo += [(child, rows[near == k]) for k, child in enumerate(node.children) if (near == k).any()]
        return out

    def walk(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        point = np.append(query / np.abs(query).max(), 0.0)  # its direction alone tells the order of inner products
        point *= self.reach / np.sqrt((point**2).sum())
        queue: list[tuple[float, int, Node | int]] = [(0.0, 0, self.root)]
        out, made = [], 1
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                out.append(node)
                continue
            gaps = ((node.centres - point) ** 2).sum(axis=1)
            for gap, child in zip(gaps, node.children, strict=True):
                heapq.heappush(queue, (float(gap), made, child))
                made += 1
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * points @ centres.T, axis=1)


def _grow(points: np.ndarray, branches: int, leaf_rows: int, random: np.random.Generator, next_leaf: list[int]) -> Node | int:
    distinct = np.unique(points, axis=0)
    branches = min(branches, -(-len(points) // leaf_rows))
    if len(points) <= leaf_rows or len(distinct) <= branches:
        next_leaf[0] += 1
        return next_leaf[0] - 1
    centres = distinct[random.choice(len(distinct), branches, replace=False)].copy()
    for _ in range(12):
        near = _nearest(points, centres)
        for k in range(branches):
            if (near == k).any():
                centres[k] = points[near == k].mean(axis=0)
    near = _nearest(points, centres)
    used = [k for k in range(branches) if (near == k).any()]
    if len(used) < 2:
        next_leaf[0] += 1
        return next_leaf[0] - 1
    node = Node(centres[used])
    node.children = [_grow(points[near == k], branches, leaf_rows, random, next_leaf) for k in used]
    return node


def fit_tree(sample: np.ndarray, reach: float, branches: int = 8, leaves: int = 256) -> Tree:
    """A tree of about ``leaves`` leaves over distinct vectors of the sample; nodes near the leaves branch less."""
    tree = Tree(0, 1, reach, sample.shape[1] if sample.ndim == 2 else 0)
    if len(sample):
        next_leaf = [0]
        points = np.unique(tree.lengthened(sample), axis=0)
        tree.root = _grow(points, branches, max(1, len(points) // leaves), np.random.default_rng(11), next_leaf)
        tree.leaves = next_leaf[0]
    return tree


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of vectors that take part: not null, not zero, without null or non-finite components; an id once, with its least vector."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return queries @ rows.T


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one order for every row, so equal vectors score equal."""
    return np.add.reduce(rows * query, axis=1)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """``(query_id, vec_id, score)`` of the k best rows of each query, ties to the smaller id, itself left out.

    With ``floors``, rows that score less than their query's are left out.
    """
    out = []
    for at in range(0, len(queries), 256):
        rough = _scores(queries[at : at + 256], rows)
        for q, row in enumerate(rough):
            own = query_ids[at + q]
            want = min(len(row), k + 1)
            floor = np.partition(row, len(row) - want)[len(row) - want]
            near = np.flatnonzero(row >= (floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else floor))
            near = near[ids[near] != own]
            score = exact_scores(queries[at + q], rows[near])
            if floors is not None:
                near, score = near[score >= floors[at + q]], score[score >= floors[at + q]]
            order = np.lexsort((ids[near], -score))[:k]
            out += [(int(own), int(ids[near[j]]), float(score[j])) for j in order]
    return out


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), dimensions)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; each task first keeps its own k best, so that few rows are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _compare(asked: DataFrame, blocks: DataFrame, dimensions: int, k: int) -> DataFrame:
    """k best of each query in each block that it visits, none under its floor: ``asked`` (leaf, vec_id, v, floor), ``blocks`` (leaf, block, blocks, vec_id, v)."""

    def pair(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(queries) and len(rows):
            found = best_of(queries["vec_id"].to_numpy(np.int64), _matrix(queries["v"], dimensions), rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], dimensions), k, queries["floor"].to_numpy(float))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    sizes = F.broadcast(blocks.select("leaf", "blocks").distinct())
    busy = F.broadcast(asked.groupBy("leaf").agg((F.floor(F.count(F.lit(1)) / QUERY_ROWS) + 1).cast("int").alias("turns")))  # a row for each leaf, as in sizes
    turns = F.coalesce("turns", F.lit(1))
    each = asked.join(busy, "leaf").join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v", "floor")
    dealt = blocks.join(busy, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), "block", "vec_id", "v")
    keys = ["leaf", "block", "turn"]
    return each.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score double")


def calibrate(tree: Tree, placed: DataFrame, k: int, recall: float, queries: int = 96) -> int:
    """Leaves of the tree to visit so that ``queries`` sample queries, held against all rows, find ``recall`` of their k nearest."""
    sample = placed.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(queries).select("vec_id", "v").toPandas()
    ids, points = sample["vec_id"].to_numpy(np.int64), _matrix(sample["v"], tree.dimensions)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leaf = dict(zip(frame["vec_id"], frame["leaf"], strict=True))
            found = best_of(ids, points, frame["vec_id"].to_numpy(np.int64), _matrix(frame["v"], tree.dimensions), k)
            yield pd.DataFrame([(q, v, s, leaf[v]) for q, v, s in found], columns=["query_id", "vec_id", "score", "leaf"])

    partial = placed.select("vec_id", "v", "leaf").mapInPandas(scan, "query_id long, vec_id long, score double, leaf long")
    true = _ranked(partial, k).toPandas()  # k * queries rows
    needed = []
    for query, own in true.groupby("query_id"):
        order = {leaf: n + 1 for n, leaf in enumerate(tree.walk(points[np.flatnonzero(ids == query)[0]], tree.leaves))}
        needed += [order.get(x, 0) for x in own["leaf"]]  # long vectors need no visit to the tree
    return int(np.quantile(needed, recall, method="higher")) if needed else tree.leaves


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, sample_rows: int = 20_000, branches: int = 8, leaf_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k nearest rows found for each query row: ``query_id, rank, vec_id, score``.

    The tree is fitted on at most ``sample_rows`` rows, those with the least hash; every usable row is indexed. Its
    leaves hold about ``leaf_rows`` rows, or more where the sample has fewer than 16 rows for each such leaf, and
    leaves are cut into blocks. A query visits as many leaves as the calibration needs for ``recall``; the k-th best
    score of its first FIRST leaves is its floor in the others, so that few rows leave them. Vectors over LONG times
    the median length, a thousandth of all at most, are held against every query.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id.
    Rows of one id are one candidate with the least of its vectors; equal scores rank by the smaller id. Vectors of
    different lengths are an error. An empty table gives an empty result; other columns are not read.
    """
    largest = F.array_max(F.transform("v", F.abs))
    norm = largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))
    rows = materialise(usable(vectors, id_col, vector_col).withColumn("norm", norm), "vectors")
    total, dimensions, least, middle = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v")), F.percentile_approx("norm", [0.5, 0.999], 10_000)).first()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    if least != dimensions:
        raise ValueError(f"vectors have {least} to {dimensions} components")
    is_long = F.col("norm") > max(LONG * middle[0], middle[1])
    reach, n_long = rows.agg(F.max(F.when(~is_long, F.col("norm"))), F.count_if(is_long)).first()
    sample = rows.where(~is_long & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(min(1 << 20, int((1 << 20) * 1.2 * sample_rows / total) + 1))))
    sample = _matrix(sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()["v"], dimensions)
    tree = fit_tree(sample, float(reach), branches, max(1, min(total // leaf_rows, len(sample) // 16)))

    @F.pandas_udf("long")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(tree.leaf_of(_matrix(v, dimensions)))

    usual = rows.where(~is_long).select("vec_id", "v", leaf("v").alias("leaf"))
    placed = materialise(usual.unionByName(rows.where(is_long).select("vec_id", "v", F.lit(tree.leaves).cast("long").alias("leaf"))), "vector-leaves")
    visits = calibrate(tree, placed, k, recall)
    own_leaf = [tree.leaves] if n_long else []

    @F.pandas_udf("array<long>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([own_leaf + tree.walk(x, visits) for x in _matrix(v, dimensions)])

    counts = placed.groupBy("leaf").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("blocks"))  # a row for each leaf
    blocks = placed.join(F.broadcast(counts), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = materialise(rows.where(is_query).withColumn("_leaves", walk("v")), "vector-queries")
    first = FIRST + len(own_leaf)
    begun = asked.select("vec_id", "v", F.lit(float("-inf")).alias("floor"), F.explode(F.slice("_leaves", 1, first)).alias("leaf"))
    near = materialise(_ranked(_compare(begun, blocks, dimensions, k), k), "vector-near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    others = F.slice("_leaves", first + 1, max(1, visits))
    rest = asked.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.explode(others).alias("leaf"))
    both = near.drop("rank").unionByName(_compare(rest, blocks, dimensions, k))
    return _ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: rows whose vec_id is divisible by 20 against all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
