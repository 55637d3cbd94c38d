"""Hard negatives by inner product: a ball tree in each partition of the rows, searched by branch and bound.

Rows are dealt by a hash of their id into partitions of bounded size, and each partition gets one tree whose upper
nodes part the labels and whose lower nodes are balls. A ball's centre and radius bound every inner product in it from
above and below: a node goes when all of it lies outside an anchor's window of scores or strictly beneath the
anchor's current k-th best. Anchors are cut into blocks and trees into groups; a task takes one block, holds it, and
reads the trees of one group against it, one after another. Blocks and trees meet by repartitioning, never by a join,
since a block copied for each group is far larger than the optimiser takes it for and must not be broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.llm.common import materialise

#: Rows of a partition, which has one tree, and of a ball that isn't split.
PARTITION_ROWS, LEAF_ROWS = 8192, 128
#: Anchors of a block, which each tree is sent to, and anchors that go down a tree at a time.
BLOCK_ROWS, ANCHOR_ROWS = 32768, 4096
#: Scaled components are cut to this, so that a hundred times the inner product of up to 2048 components fits 64 bits.
LIMIT = 1 << 22
NONE = -(1 << 62)


@dataclass
class BallTree:
    """Rows in the order of the leaves, and the balls over them; ``roots`` are ``(label, node)``."""

    ids: np.ndarray
    rows: np.ndarray
    roots: list[tuple[int, int]] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    children: list[tuple[int, int] | None] = field(default_factory=list)


def build_tree(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
    """A tree over integer ``rows``; a ball is halved along the line between two of its far points."""
    order = np.lexsort((ids, labels))
    tree = BallTree(ids[order], rows[order].astype(np.int32))
    labels = labels[order]
    starts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else []
    for start, stop in zip(starts, [*starts[1:], len(labels)], strict=True):
        tree.roots.append((int(labels[start]), _ball(tree, start, stop, leaf_rows)))
    return tree


def _ball(tree: BallTree, start: int, stop: int, leaf_rows: int) -> int:
    points = tree.rows[start:stop].astype(float)
    centre = points.mean(axis=0)
    gaps = np.sqrt(((points - centre) ** 2).sum(axis=1))
    node = len(tree.centres)
    tree.centres.append(centre)
    tree.radii.append(float(gaps.max()))
    tree.spans.append((start, stop))
    tree.children.append(None)
    if stop - start > leaf_rows and gaps.max() > 0:  # equal points stay one leaf
        one = points[np.argmax(gaps)]
        other = points[np.argmax(((points - one) ** 2).sum(axis=1))]
        order = start + np.argsort(points @ (other - one), kind="stable")
        tree.rows[start:stop], tree.ids[start:stop] = tree.rows[order], tree.ids[order]
        middle = (start + stop) // 2
        tree.children[node] = (_ball(tree, start, middle, leaf_rows), _ball(tree, middle, stop, leaf_rows))
    return node


@dataclass
class Asked:
    """A block of anchors and what is asked of them: for each question its anchor's place, a window of scores and a key."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def parts(self, rows: int) -> Iterator[Asked]:
        """At most ``rows`` anchors each, with their questions."""
        for start in range(0, len(self.ids), rows):
            stop = start + rows
            held = (self.anchor >= start) & (self.anchor < stop)
            yield Asked(self.ids[start:stop], self.labels[start:stop], self.rows[start:stop], self.anchor[held] - start, self.key[held], self.low[held], self.high[held])


def _most(a: np.ndarray) -> float:
    """The largest absolute value."""
    return float(max(int(a.max(initial=0)), -int(a.min(initial=0))))


def _narrow(rows: np.ndarray) -> np.ndarray:
    """``rows`` in the shortest signed integers that hold them."""
    return rows.astype(next(kind for kind in (np.int8, np.int16, np.int32) if _most(rows) <= np.iinfo(kind).max))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``: by floats where all sums are below 2^53."""
    most = _most(a) * _most(b) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_tree(tree: BallTree, asked: Asked, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best ``(scores, ids)`` of each question within its window, ties to the smaller id, and how many leaves were compared.

    With ``same`` the rows of the anchor's label, itself left out, else those of all other labels. Empty places score NONE.
    """
    scores = np.full((len(asked.anchor), k), NONE, np.int64)
    ids = np.full((len(asked.anchor), k), np.iinfo(np.int64).max, np.int64)
    points = asked.rows.astype(float)
    norms = np.sqrt((points**2).sum(axis=1))
    compared = 0

    def bounds(node: int, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = asked.anchor[questions]
        middle, reach = points[own] @ tree.centres[node], norms[own] * tree.radii[node]
        return middle - reach, middle + reach, 1e-6 + 1e-9 * (np.abs(middle) + reach)

    def visit(node: int, questions: np.ndarray) -> None:
        nonlocal compared
        least, most, slack = bounds(node, questions)
        stays = (most + slack >= np.maximum(asked.low[questions], scores[questions, -1])) & (least - slack <= asked.high[questions])
        questions = questions[stays]
        if not len(questions):
            return
        if (below := tree.children[node]) is not None:
            nearer = sorted(below, key=lambda child: -bounds(child, questions)[1].mean())
            for child in nearer:
                visit(child, questions)
            return
        compared += 1
        start, stop = tree.spans[node]
        anchors, place = np.unique(asked.anchor[questions], return_inverse=True)
        found = inner(asked.rows[anchors], tree.rows[start:stop])
        if same:
            found[asked.ids[anchors][:, None] == tree.ids[None, start:stop]] = NONE
        found = found[place]
        found[(found < asked.low[questions, None]) | (found > asked.high[questions, None])] = NONE
        hit = (found >= np.maximum(scores[questions, -1], NONE + 1)[:, None]).any(axis=1)
        questions, found = questions[hit], found[hit]
        both = np.concatenate([scores[questions], found], axis=1)
        who = np.concatenate([ids[questions], np.broadcast_to(tree.ids[start:stop], found.shape)], axis=1)
        who = np.where(both == NONE, np.iinfo(np.int64).max, who)
        best = np.lexsort((who, -both), axis=1)[:, :k]
        scores[questions], ids[questions] = np.take_along_axis(both, best, 1), np.take_along_axis(who, best, 1)

    of_question = asked.labels[asked.anchor]
    for label, root in tree.roots:
        own = np.flatnonzero((of_question == label) if same else (of_question != label))
        if len(own):
            visit(root, own)
    return scores, ids, compared


def usable(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, label, v`` of rows that take part, ``v`` in integers; an id once, with its least label and vector."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return rows.select("vec_id", "label", whole.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row")).select("vec_id", "_row.label", "_row.v")


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(column), dimensions), np.int32)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _best(trees: DataFrame, blocks: DataFrame, deals: int, turns: int, same: bool, k: int) -> DataFrame:
    """``anchor_id, positive_id, vec_id, score``: the k best of each question in each tree."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for group, turn, is_tree, body in zip(*batch.columns, strict=True):
                if not is_tree.as_py():  # a block comes before the trees of its cell
                    held, block = (group, turn), pickle.loads(body.as_py())
                    continue
                if held != (group, turn):
                    continue
                tree = pickle.loads(body.as_py())
                for questions in block.parts(ANCHOR_ROWS):
                    scores, ids, _ = search_tree(tree, questions, same, k)
                    question, place = np.nonzero(scores > NONE)
                    own = questions.ids[questions.anchor[question]]
                    columns = (own, questions.key[question], ids[question, place], scores[question, place])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor_id", "positive_id", "vec_id", "score"])

    spark = trees.sparkSession
    cells = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = min(deals, -(-cells // turns))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = trees.select((F.col("deal") % groups).alias("group"), each(turns).alias("turn"), F.lit(True).alias("is_tree"), F.col("tree").alias("body"))
    met = sent.unionByName(blocks.select(each(groups).alias("group"), "turn", F.lit(False).alias("is_tree"), F.col("block").alias("body")))
    dealt = met.repartition(groups * turns, "group", "turn").sortWithinPartitions("group", "turn", "is_tree")
    return dealt.mapInArrow(hold, "anchor_id long, positive_id long, vec_id long, score long")


def _hundredth(whole: Column) -> Column:
    """The floor of a hundredth of a whole number."""
    return F.call_function("div", whole - F.pmod(whole, F.lit(100)), F.lit(100))


def _ranked(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", partition_rows: int = PARTITION_ROWS, anchor_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``, ``label`` a column of the rows. A component x counts as
    floor(scale * x), cut to 2^22 either way, a score is the integer inner product with the anchor, ties go to the
    smaller id. An anchor's ``positives`` are its best other rows of its label; for each of them come the
    ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; zero vectors do, and
    vectors of unequal lengths are filled with zeros. Repeated ids are one row, the one with the least label and
    vector. Other columns are not read. An empty table, or one without anchors, gives an empty result.
    """
    rows = materialise(usable(vectors, label, id_col, vector_col, scale), "mining-rows")
    total, anchors, dimensions = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("v"))).first()
    if not anchors:
        return rows.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(1).alias("rank"), F.col("vec_id").alias("negative_id"), F.lit(0).cast("long").alias("positive_score"), F.lit(0).cast("long").alias("negative_score")).limit(0)
    deals, turns = -(-total // partition_rows), -(-anchors // anchor_rows)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), _matrix(part["v"], dimensions))
        tree.rows = _narrow(tree.rows)
        return pd.DataFrame({"deal": [part["deal"].iloc[0]], "tree": [pickle.dumps(tree)]})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        counts = part["wanted"].map(len).to_numpy(np.int64)
        wanted = [w for own in part["wanted"] for w in own]
        of = [np.array([w[name] for w in wanted], np.int64) for name in ("key", "low", "high")]
        block = Asked(part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), _narrow(_matrix(part["v"], dimensions)), np.repeat(np.arange(len(part)), counts), *of)
        return pd.DataFrame({"turn": [part["turn"].iloc[0]], "block": [pickle.dumps(block)]})

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(deals)).cast("int"))
    trees = materialise(dealt.groupBy("deal").applyInPandas(grow, "deal int, tree binary"), "ball-trees")

    def questions(wanted: DataFrame) -> DataFrame:
        turn = wanted.withColumn("turn", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(turns)).cast("int"))
        return turn.groupBy("turn").applyInPandas(pack, "turn int, block binary")

    own = rows.where(is_anchor)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(NONE + 1).alias("low"), F.lit(-NONE).alias("high")))
    near = _ranked(_best(trees, questions(own.withColumn("wanted", everything)), deals, turns, True, positives), ["anchor_id"], positives)
    near = materialise(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    window = F.struct(F.col("positive_id").alias("key"), (-_hundredth(F.col("positive_score") * -low)).alias("low"), _hundredth(F.col("positive_score") * high).alias("high"))
    asked = own.join(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window).alias("wanted")), "vec_id")
    far = _ranked(_best(trees, questions(asked), deals, turns, False, negatives), ["anchor_id", "positive_id"], negatives)
    return far.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: anchors are rows whose vec_id is divisible by 100; labels of multiples of 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
