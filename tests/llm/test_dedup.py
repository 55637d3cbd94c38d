"""Exact and near dedup, sharding."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairgrid.llm import common, exact_dedup, minhash, sharding
from fairgrid.llm.common import join_hot
from tests.llm.conftest import AWKWARD, build, sentence


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, i if len(groups[t or ""]) == 1 else best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact_against_brute_force(docs, awkward, nothing):
    for table in (docs, awkward):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        assert Counter(map(tuple, exact_dedup.deduplicate(table, keep="max").collect())) == brute_exact(rows)
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_exact_with_one_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", None) for i in range(3000)]
    got = exact_dedup.deduplicate(build(spark, rows), keep="min").where("kept").agg(F.count("*"), F.sum(F.col("group_size"))).first()
    assert tuple(got) == (1001, 3000)


def test_merge_index(spark):
    index = exact_dedup.MergeIndex(spark, "min")
    for start in (0, 50, 100):
        index.add(spark.range(start, start + 100).select(F.col("id").alias("doc_id"), F.sha2((F.col("id") % 60).cast("string"), 256).alias("text_sha256")))
    assert len(index.runs) == 3
    entries = index.compact().entries()
    assert len(index.runs) == 1 and entries.count() == 60
    assert entries.agg(F.sum("group_size"), F.min("keep_id"), F.max("keep_id")).first() == (300, 0, 59)
    assert [r.keep_id for r in index.find([hashlib.sha256(b"7").hexdigest()]).collect()] == [7]
    files = spark.read.parquet(index.runs[0]).select("text_sha256", F.input_file_name().alias("f"))
    for r in files.groupBy("f").agg(F.collect_list("text_sha256").alias("d")).collect():
        assert r.d == sorted(r.d)


def test_exact_with_many_memtables(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, exact_dedup.deduplicate(docs, keep="max", memtable_rows=30).collect())) == brute_exact(rows)


def test_filter_holds_all_hits_and_few_others(spark):
    digests = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"), "id")
    parts = exact_dedup.parts_for(2000)
    told = exact_dedup.filter_of(digests.where("id < 2000"), parts)
    got = [r.id for r in exact_dedup.may_be_in(digests, told, parts).collect()]
    assert set(range(2000)) <= set(got) and len(got) == len(set(got)) < 2000 + 0.12 * 18_000


def test_two_texts_of_one_digest_are_told(spark):
    rows = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c"), ("e", "c"), ("f", "z")], "text_sha256 string, text string")
    assert {r.text_sha256: r.variants for r in exact_dedup.verified(rows).collect()} == {"d": 2, "e": 1}


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    ids, parent = sorted(sets), {}

    def root(a):
        while parent.get(a, a) != a:
            a = parent[a]
        return a

    for x, a in enumerate(ids):
        for b in ids[:x]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= 75 * len(s | t):
                        p, q = root(a), root(b)
                        parent[max(p, q)] = min(p, q)
    return Counter((i, len(shingle_set(t)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows)


def test_near_against_brute_force(docs, awkward, nothing):
    for table in (docs, awkward):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        assert Counter(map(tuple, minhash.near_duplicates(table).collect())) == brute_near(rows)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_chain_and_hot_group(spark):
    """A chain whose ends are far apart, and many near copies of one text."""
    base = sentence(1, 80).split()
    rows = [(i, " ".join([*(f"new{i}x{k}" for k in range(3 * i)), *base[3 * i :], *(f"end{i}x{k}" for k in range(0))]), None) for i in range(8)]
    rows += [(100 + i, sentence(11, 90) + f" tail{i}", None) for i in range(150)] + [(400 + i, sentence(40 + i, 70), None) for i in range(20)]
    got = Counter(map(tuple, minhash.near_duplicates(build(spark, rows)).collect()))
    assert got == brute_near([(i, t) for i, t, _ in rows])


def test_near_in_a_bucket_of_many_components(spark, monkeypatch):
    """A template that texts share most of, but not enough to link: buckets of hundreds of components, a few pairs among them."""
    monkeypatch.setattr(minhash, "BLOCK", 128)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1 << 14)
    template = " ".join(f"word{k}" for k in range(134))
    rows = [(i, template + " " + " ".join(f"own{i}x{k}" for k in range(35)), None) for i in range(500)]
    rows += [(1000 + i, rows[i * 7][1].rsplit(" ", 10)[0] + " " + " ".join(f"other{i}x{k}" for k in range(10)), None) for i in range(40)]
    rows += [(2000 + i, template + " " + " ".join(f"long{i}x{k}" for k in range(400)), None) for i in range(20)]
    want = brute_near([(i, t) for i, t, _ in rows])
    assert sum(not kept for *_, kept in want) == 40
    assert Counter(map(tuple, minhash.near_duplicates(build(spark, rows)).collect())) == want


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_hot_keys_join_like_others(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    many = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 2000 if i % 5 else None) for i in range(9000)], "x long, k long")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 2000, 2)] + [(7, "hot")], "k long, v string")
    for how in ("inner", "left"):
        got = Counter(map(tuple, join_hot(many, one, "k", how).select("x", "k", "v").collect()))
        assert got == Counter(map(tuple, many.join(one, "k", how).select("x", "k", "v").collect()))
    assert join_hot(many.limit(0), one, "k").count() == 0


def test_groups_of_adjacent_keys():
    keys = [2**62, 2**62, 2**62 + 1, 2**62 + 2, 2**62 + 2]
    frame = pd.DataFrame({"key": keys, "block": [0] * 5})
    cuts = [(rows["key"].iloc[a], b - a) for rows, starts, ends in minhash._slices(iter([frame.iloc[:3], frame.iloc[3:]]), ["key", "block"]) for a, b in zip(starts, ends)]
    assert cuts == [(2**62, 2), (2**62 + 1, 1), (2**62 + 2, 2)]


def test_planted_pairs_share_a_band():
    """Pairs of similarity 0.75: the minima agree as often, and no pair is missed by bands or by the floor on estimates."""
    random = np.random.default_rng(8)
    agree, missed = [], 0
    for _ in range(2000):
        hashes = random.integers(0, 1 << 63, 160, np.uint64) * np.uint64(2)
        a, b = (minhash.minima(np.sort(x)) for x in (hashes[:140], np.concatenate([hashes[:120], hashes[140:160]])))  # 120 of 160
        agree.append(np.mean(a == b))
        bits = [minhash.packed_bits(x)[None] for x in (a, b)]
        missed += not (minhash.band_keys(a) == minhash.band_keys(b)).any() or minhash._likeness(*bits)[0, 0] < minhash.FLOOR
    assert np.mean(agree) == pytest.approx(0.75, abs=0.01) and missed == 0


def test_near_needs_integer_ids(spark):
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("share", [0.75, 0.85, 0.95])
def test_estimate_is_corrected(spark, share):
    base = [f"w{i}" for i in range(2000)]
    n = int(2000 * 2 * share / (1 + share))  # common shingles of two sets of 2000
    texts = [" ".join(base), " ".join(base[:n] + [f"o{i}" for i in range(2000 - n)])]
    bits = [minhash.packed_bits(minhash.minima(minhash.shingles(t))).tolist() for t in texts]
    names = [f"a{k} long" for k in range(4)] + [f"b{k} long" for k in range(4)]
    row = spark.createDataFrame([(*bits[0], *bits[1])], ", ".join(names))
    assert row.select(minhash.estimate("a", "b")).first()[0] == pytest.approx(share, abs=0.17)


def test_sharding_law_and_links(spark, docs, awkward, nothing):
    for table, shards in ((docs, 8), (awkward, 4)):
        rows = [(t or "", i, t) for i, t in (tuple(r) for r in table.select("doc_id", "text").collect())]
        got = sharding.shard_documents(table, shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for x, i, _ in rows)
        by_shard = defaultdict(list)
        for r in got:
            assert r.law == "rows" and r.grown_shard is None
            by_shard[r.shard].append(r.slot)
        counts = [len(by_shard.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_sharding_keeps_groups_together(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 3 == 1 else f"own {i}", None) for i in range(1200)]
    got = sharding.shard_documents(build(spark, rows), 8).collect()
    text = dict((i, t) for i, t, _ in rows)
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert len(where["hot"]) <= 5  # 400 copies, quotas of 150
    pairs = [x for t, x in where.items() if t.startswith("pair")]
    assert sum(len(x) == 1 for x in pairs) >= 0.9 * len(pairs)
    assert len(AWKWARD) == 18


def shards_by_text(spark, texts, shards=8):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), shards).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) == len(rows)
    where, counts = defaultdict(Counter), Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for r in got:
        where[texts[r.doc_id]][r.shard] += 1
    return where


def test_sharding_of_pairs_only(spark):
    where = shards_by_text(spark, [f"pair {i // 2}" for i in range(6400)])
    assert sum(len(x) > 1 for x in where.values()) <= 8


def test_sharding_of_copies_only_in_uneven_groups(spark):
    where = shards_by_text(spark, [f"group {min(i, 6006 - i) // 3} {i % 2}" for i in range(6007)], 7)
    assert sum(len(x) > 1 for t, x in where.items() if sum(x.values()) > 1) <= 7


def test_sharding_of_a_group_of_a_third(spark):
    where = shards_by_text(spark, ["hot"] * 2000 + [f"pair {i // 2}" for i in range(4000)])
    assert sorted(where["hot"].values()) == [500, 750, 750]  # quotas of 750
    assert sum(len(x) > 1 for x in where.values()) <= 9
