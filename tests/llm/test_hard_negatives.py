"""Hard negatives against a plain search, ball bounds, and the query against its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgrid.llm import hard_negatives
from fairgrid.llm.hard_negatives import NONE, Asked, build_tree, inner, search_tree

SCHEMA = "vec_id long, embedding array<double>, label int, deal int, tree string, turn int, v string, score long"


def plain(rows, every, positives=5, negatives=5, low=80, high=100):
    """Every pair of anchor and row, in Python's whole numbers."""
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [int(max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, math.floor(256 * x)))) for x in vector])
        kept[vec_id] = min(kept.get(vec_id, own), own)
    out = set()
    for anchor, (label, v) in kept.items():
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != anchor]
        for score, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted(x for x in scored if x[2] != label and low * -score <= 100 * -x[0] <= high * -score)
            out |= {(anchor, positive, rank + 1, negative, -score, -own) for rank, (own, negative, _) in enumerate(inside[:negatives])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "v", 3) for r in rows], SCHEMA)


def mined(spark, rows, every, **settings):
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % every == 0, F.col("label"), **settings).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_equals_a_plain_search(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=6) * (10 if i % 50 == 7 else 1)], int(random.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]  # one vector many times, over labels
    want = plain(rows, 10)
    assert len(want) > 500
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, partition_rows=100, anchor_rows=16) == want
    assert mined(spark, rows, 10, positives=2, negatives=3, low=50, high=90) == plain(rows, 10, 2, 3, 50, 90)


def test_blocks_and_trees_meet_without_a_join(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.integers(-128, 128, 4) / 256], i % 3) for i in range(600)] + [(600, [-0.5] * 4, 0)]
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"), partition_rows=50, anchor_rows=20)
    assert {tuple(r) for r in found.collect()} == plain(rows, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Join" in x and "turn#" in x]  # a block copied for each tree was broadcast


def test_blocks_in_parts():
    random = np.random.default_rng(6)
    rows = random.integers(-50, 50, (500, 6))
    tree = build_tree(np.arange(500), np.arange(500) % 3, rows, leaf_rows=16)
    asked = Asked(np.arange(40), np.arange(40) % 3, rows[:40], np.repeat(np.arange(40), np.arange(40) % 3), np.arange(39), np.full(39, -1000), np.arange(39) * 100)
    whole = search_tree(tree, asked, False, 3)
    parts = [(part.key, *search_tree(tree, part, False, 3)[:2]) for part in asked.parts(7)]
    assert len(parts) == 6
    for k, want in enumerate((asked.key, *whole[:2])):
        assert (np.concatenate([p[k] for p in parts]) == want).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [1.0, 0.4], 2), (4, [1.0, 0.4], 3), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [0.0, 0.0], 1), (2, [0.9, 0.5], 2), (20, [1e9, -1e9], 1), (21, [1e200, 1.0], 2), (-30, [-1.0, -1.0], 1), (22, [], 2), (23, [2.0], 3)]
    assert mined(spark, rows, 10) == plain(rows, 10)
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == set()
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 10) == set()


@pytest.mark.parametrize("spread", [1, 1000])
def test_bounds_prune_and_lose_nothing(spread):
    random = np.random.default_rng(spread)
    centres = random.integers(-300, 300, (40, 8))
    rows = np.concatenate([c + random.integers(-5, 6, (100, 8)) * (1 if k % 7 else spread) for k, c in enumerate(centres)])
    ids, labels = random.permutation(len(rows)), random.integers(0, 3, len(rows))
    tree = build_tree(ids, labels, rows, leaf_rows=32)
    anchors = random.choice(len(rows), 25, replace=False)
    scores = inner(rows[anchors], rows)
    top = np.sort(scores, axis=1)[:, -30]
    asked = Asked(ids[anchors], labels[anchors], rows[anchors], np.arange(25), np.zeros(25, np.int64), -(-8 * top // 10), top)
    for same in (True, False):
        got, found, compared = search_tree(tree, asked, same, 4)
        for k, anchor in enumerate(anchors):
            fits = [(-scores[k, j], ids[j]) for j in range(len(rows)) if (labels[j] == labels[anchor]) == same and j != anchor and asked.low[k] <= scores[k, j] <= asked.high[k]]
            assert [(-s, i) for s, i in zip(got[k], found[k], strict=True) if s != NONE] == sorted(fits)[:4]
    alone = Asked(*(x[:1] for x in (asked.ids, asked.labels, asked.rows, asked.anchor, asked.key, asked.low, asked.high)))
    leaves = sum(c is None for c in tree.children)
    if spread == 1:
        assert search_tree(tree, alone, True, 4)[2] < leaves / 4  # clusters are pruned by both bounds


def test_inner_products_beyond_floats():
    a = np.full((1, 2048), hard_negatives.LIMIT, np.int32)
    assert inner(a, a)[0, 0] == 2048 * hard_negatives.LIMIT**2


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '/root/testdata/{folder}/embeddings.parquet'")
    want = con.sql(hard_negatives.OP13_SQL)
    got = hard_negatives.op13_hard_negatives(spark, f"/root/testdata/{folder}")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
