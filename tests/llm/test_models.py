"""Toxicity, archives, vector search and the pipeline."""

import itertools
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairgrid.llm import toxicity, vectors, warc
from fairgrid.llm.common import materialise, new_path, scratch
from tests.llm.conftest import AWKWARD, sentence

MODEL = toxicity.ToxicityModel({"idiot$": 4.0, "dumm": 3.0})


def kinds(sentence):
    lexicon = toxicity.Lexicon(MODEL)
    words = sentence.lower().split()
    return [(k, words[at]) for k, _, at in toxicity.clause_matches([lexicon[w] for w in words])]


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("you are an idiot", [("aimed", "idiot")]), ("an idiot appears", [("bare", "idiot")]), ("you are not an idiot", [("negated", "idiot")]), ("she said an idiot came", [("reported", "idiot")]),
        ("i will kill you", [("threat", "kill")]), ("kill the process", []), ("du dummkopf", [("bare", "dummkopf")]), ("a fine day", []),
    ],
)
def test_clauses(sentence, want):
    assert kinds(sentence) == want


def test_negation_stops_at_the_clause():
    names = dict(zip(toxicity.FEATURES, toxicity.features("I did not. You idiot", toxicity.Lexicons(MODEL)), strict=True))
    assert names["aimed"] > 0 and names["negated"] == 0


def told_plainly(clause):
    """What the grammar says of a clause of symbols, by looking at the places around each one."""
    t, found = toxicity, []
    for at, symbol in enumerate(clause):
        if symbol not in (t.INSULT, t.THREAT):
            continue
        near = lambda kinds, reach: [at - k for k in range(max(0, at - reach), at) if clause[k] in kinds]
        after = [k - at for k in range(at + 1, min(len(clause), at + 1 + t.REACH)) if clause[k] == t.TARGET]
        before = near((t.TARGET, t.COPULA), t.REACH)
        weight = (-0.05 * (min(before) - 1) if before else 0) + (-0.05 * (min(after) - 1) if after else 0)
        if symbol == t.THREAT and not (before or after):
            continue
        kind = "threat" if symbol == t.THREAT else "aimed" if before or after else "bare"
        if near((t.NEGATION,), t.REACH // 2):
            kind = "negated"
        else:
            closed = min(near((t.CLOSE,), at), default=at + 1)  # how far the last closing mark is; it ends reports before it
            marks = [x for x in clause[:at] if x in (t.OPEN, t.CLOSE)]
            if (marks and marks[-1] == t.OPEN) or any(k < closed for k in near((t.REPORT,), t.REACH)):
                kind = "reported"
        found.append((kind, at, round(weight, 9)))
    return found


def test_grammar_against_brute_force():
    """All clauses of up to four symbols, and long ones at random."""
    inputs = [toxicity.OTHER, toxicity.TARGET, toxicity.COPULA, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.THREAT, toxicity.OPEN, toxicity.CLOSE]
    random = np.random.RandomState(5)
    clauses = [c for n in range(5) for c in itertools.product(inputs, repeat=n)] + [tuple(random.choice(inputs, 25, p=[0.5, 0.1, 0.05, 0.05, 0.05, 0.1, 0.05, 0.05, 0.05])) for _ in range(2000)]
    for clause in clauses:
        got = [(kind, at, round(float(np.log(weight)), 9) + 0.0) for kind, weight, at in toxicity.clause_matches([(int(x), 1.0) for x in clause])]
        assert got == [(k, at, w + 0.0) for k, at, w in told_plainly(clause)], clause


def test_composition_is_one_machine_after_the_other():
    random = np.random.RandomState(6)
    parts = [toxicity.PRECEDED, toxicity.ALONE, toxicity.DENIED, toxicity.TOLD]
    for _ in range(500):
        clause = random.randint(0, 11, 20).tolist()
        symbols, total = clause, np.zeros(20)
        for part in parts:
            symbols, weights = part.run(symbols)
            total += weights
        outs, weights = toxicity.GRAMMAR.run(clause)
        assert outs == symbols and np.allclose(weights, total)


def test_quoted_and_denied_insults_score_less():
    model = toxicity.ToxicityModel({"idiot$": 4.0}, (0.5, 1.0, -0.5, -0.5, 1.0, 1.0, 0.2, 0.5), -3.0)
    score = lambda x: toxicity.features(x, toxicity.Lexicons(model)) @ np.array(model.coefficients)
    assert score("You are an idiot.") > score("An idiot came by.") > max(score("You are not an idiot."), score('He said "idiot".'))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ('He said "hello", you idiot', "aimed"), ('"Hello" you idiot', "aimed"), ('He said "you idiot" and left', "reported"), ('She wrote: "Go away. You idiot. Bye." and left', "reported"), ('She wrote: "Go away. Bye." You idiot', "aimed"),
        ('a 5" screen and you idiot', "aimed"), ('he wrote "\nyou idiot"', "aimed"), ("du bist ein dummkopf und das ist nicht", "aimed"), ("„du dummkopf“ sagte der mann", "reported"), ("das ist die frau die er liebt", None), ("he will die and they kill him", "threat"),
    ],
)
def test_quotes_are_paired_and_words_are_of_one_language(text, kind):
    told = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Lexicons(MODEL)), strict=True))
    assert [k for k in ("bare", "aimed", "negated", "reported", "threat") if told[k]] == [kind] * (kind is not None)


def test_clean_texts_of_each_language_hold_few_threats(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").select("text", "lang").collect()
    blank, share = toxicity.Lexicons(toxicity.ToxicityModel({})), {}
    for text, lang in rows:
        share.setdefault(lang, []).append(toxicity.features(text, blank)[toxicity.FEATURES.index("threat")] > 0)
    assert len(share) == 4 and all(np.mean(own) < 0.01 for own in share.values())


@pytest.mark.parametrize(("folder", "auc", "recall"), [("sf0.01", 0.8, 0.5), ("sf0.1", 0.955, 0.88)])
def test_toxicity_held_out(spark, folder, auc, recall):
    folder = f"/root/testdata/{folder}"
    got = toxicity.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    ones, zeros = ([r.score for r in got if r.held_out and r.toxic == y] for y in (1, 0))
    assert np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones]) > auc and np.mean([a >= 0.5 for a in ones]) >= recall
    assert np.mean([b >= 0.5 for b in zeros]) < 0.03


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    got = toxicity.score_documents(awkward, MODEL).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert toxicity.score_documents(awkward, toxicity.fit(awkward, labels)).count() == len(AWKWARD)


PAGES = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "http://b", "short"), (4, "http://b", "short"), (5, "u", None), (6, "é", "é" * 60 + "\r\n\r\nWARC/1.1"), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1"), (8, "u", "y" * 3_000_000), (9, "u", "y" * 3_000_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = new_path(spark, "warc-test")
    index = warc.write_bundles(pages, folder, bundles=2, frame_bytes=1000)
    got = {r.page_id: r for r in warc.read_bundles(spark, folder).collect()}
    revisits = {2: 1, 7: 6, 9: 8}
    for page_id, url, html in PAGES:
        r, data = got[page_id], (html or "").encode()
        assert (r.url, r.payload_bytes, r.refers_to) == (url or "", len(data), revisits.get(page_id))
        assert r.record_type == ("revisit" if page_id in revisits else "response")
        assert page_id in revisits or bytes(r.payload) == data
    entries = [r.asDict() for r in index.collect()]
    assert Counter(e["page_id"] for e in entries) == Counter(p[0] for p in PAGES) and max(e["frame"] for e in entries) > 0
    for entry, record in zip(entries, warc.read_records(folder, entries), strict=True):
        assert int(record["X-Page-ID"]) == entry["page_id"]


def test_archives_of_nothing_and_no_id(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_bundles(empty, new_path(spark, "warc-test"), bundles=1).count() == 0
    odd = spark.createDataFrame([(None, None, "a" * 150), (3, "u", "a" * 150), (3, "u", "a" * 150)], "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    warc.write_bundles(odd, folder, bundles=1)
    assert warc.read_bundles(spark, folder).count() == 3


def test_archives_keep_large_ids_and_any_url(spark):
    ids = [2**60 + 1, 2**60 + 3, 2**63 - 1, None]
    urls = ["http://a\r\nX-Page-ID: 5\r\n\r\nWARC/1.1", "http://b%0D\n", "plain: %41", "\x00\x7f\x85"]
    pages = spark.createDataFrame([(i, u, "p" * 200) for i, u in zip(ids, urls)], "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    index = {r.page_id for r in warc.write_bundles(pages, folder, bundles=1).collect()}
    got = {r.page_id: r for r in warc.read_bundles(spark, folder).collect()}
    assert index == set(ids) and {i: got[i].url for i in ids} == dict(zip(ids, urls))
    assert [got[i].refers_to for i in ids[1:3]] == [2**60 + 1] * 2


def test_archives_have_one_order(spark):
    """Rows that differ in their url alone lie in the same places however they come."""
    pages = [(k % 3, f"http://u{k % 7}", "p" * (150 + k % 2)) for k in range(60)]
    written = []
    for parts in (1, 5):
        folder = new_path(spark, "warc-test")
        table = spark.createDataFrame(pages[:: -1 if parts > 1 else 1], "page_id long, url string, html string").repartition(parts)
        warc.write_bundles(table, folder, bundles=2, frame_bytes=1000)
        written.append(sorted((r.page_id, r.url, r.record_type) for r in warc.read_bundles(spark, folder).collect()))
    assert written[0] == written[1] and len(written[0]) == 60


def test_archives_query_without_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op7_warc(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    want = Counter(con.sql(warc.OP7_SQL).fetchall())
    assert Counter(map(tuple, warc.op7_warc(spark, small).collect())) == want


def brute(ids, rows, query, k):
    score = rows @ rows[ids == query][0]
    near = [(-s, i) for s, i in zip(score, ids, strict=True) if i != query]
    return [i for _, i in sorted(near)[:k]]


def test_search_recall(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    pairs = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, rows = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    got = {}
    for r in vectors.op9_vector_search(spark, small).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert r.score == pytest.approx(float(rows[ids == r.query_id][0] @ rows[ids == r.vec_id][0]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = [len({v for _, v, _ in own} & set(brute(ids, rows, q, 20))) / 20 for q, own in got.items()]
    assert np.mean(hits) >= 0.9
    for own in got.values():
        assert [r for r, _, _ in sorted(own)] == list(range(1, len(own) + 1))


def recalls(found, ids, rows, k=20):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return [len(own & set(brute(ids, rows, q, k))) / k for q, own in got.items()]


@pytest.fixture
def visited(monkeypatch):
    """How many leaves of how many the calibration tells queries to visit."""
    told, plain = [], vectors.calibrate
    monkeypatch.setattr(vectors, "calibrate", lambda tree, *a, **k: told.append((plain(tree, *a, **k), tree.leaves)) or told[-1][0])
    return told


@pytest.mark.parametrize("sample_rows", [20_000, 1200])
def test_search_recall_where_leaves_are_left_out(spark, visited, sample_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, rows = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    hits = recalls(vectors.search(table, F.col("vec_id") % 20 == 0, leaf_rows=32, sample_rows=sample_rows), ids, rows)
    visits, leaves = visited[0]
    assert leaves >= 60 and visits < 0.85 * leaves
    assert len(hits) == 100 and np.mean(hits) >= 0.93 and min(hits) >= 0.6


@pytest.mark.parametrize("longest", [1e12, 1e160])
def test_search_of_unlike_norms(spark, visited, longest):
    random = np.random.default_rng(8)
    centres = random.normal(size=(40, 16))
    rows = np.concatenate([c + 0.2 * random.normal(size=(75, 16)) for c in centres]) * random.lognormal(0, 0.3, (3000, 1))
    rows[17] *= longest
    rows[18] *= -40
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    hits = recalls(vectors.search(table, F.col("vec_id") % 20 == 0, leaf_rows=32), np.arange(3000), rows)
    visits, leaves = visited[0]
    assert leaves >= 60 and visits < leaves / 3 and np.mean(hits) >= 0.93  # one long vector doesn't ruin the tree
    counts = vectors.search(table, F.col("vec_id") == 17, k=5, leaf_rows=32).collect()
    assert len(counts) == 5


def test_search_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (None, [1.0, 1.0]), (20, [0.5, -1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, leaf int, v int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.search(table, F.col("vec_id") % 20 == 0, k=3, recall=1.0).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 7, -1.0)]
    assert vectors.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_repeated_ids_and_other_lengths(spark):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 5.0]), (2, [2.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.search(table, F.col("vec_id") % 20 == 0, k=3).collect()] == [(2, 2.5), (1, 2.0)]
    with pytest.raises(ValueError):
        vectors.search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)


def test_search_with_one_vector_many_times(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else [float(np.cos(i)), float(np.sin(i)), 0.1]) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.search(table, F.col("vec_id") == 1, k=5).orderBy("rank").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert [r.vec_id for r in got] == brute(ids, points, 1, 5)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = corpus_pipeline.run(spark, small).collect()
    left = {r.doc_id for r in got}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"]
    from tests.llm.test_dedup import brute_exact, brute_near

    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, small).cache()
        assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) >= 0.85 * docs.count()
    exact = {k[0] for k in brute_exact(rows) if k[3]}
    rows = [r for r in rows if r[0] in exact]
    assert left == {k[0] for k in brute_near(rows) if k[3]}


def test_tables_go_with_their_scope(spark):
    def held(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file://"))

    outside = materialise(spark.range(3), "outside")
    with scratch(spark) as made:
        goes, stays = materialise(spark.range(4), "goes"), materialise(spark.range(5), "stays")
        made.pop()
        assert held(goes)
    assert (held(outside), held(goes), held(stays), stays.count()) == (True, False, True, 5)


def test_pipeline_drops_rows_not_ids(spark):
    b, near_b = sentence(5, 60), sentence(5, 60) + " more"
    rows = [(5, "A text"), (9, "A text"), (5, b), (7, sentence(9, 60)), (3, near_b), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.exact(spark, docs, "")
    assert Counter(map(tuple, left.collect())) == Counter(rows[1:])
    more = spark.createDataFrame([*rows, (8, sentence(9, 60) + " end")], "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.near(spark, more, "").collect())) == Counter(rows)


def test_pipeline_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, _digest string, text_sha256 string, dropped_id long, _h string, _shared boolean"
    rows = [(i, t, f"mine {i}", "own", 7, "h", True) for i, t in ((1, "same"), (2, "same"), (3, sentence(3, 60)), (4, sentence(3, 60) + " end"))]
    docs = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, corpus_pipeline.exact(spark, docs, "").collect())) == rows[1:]
    assert sorted(map(tuple, corpus_pipeline.near(spark, docs, "").collect())) == [rows[0], rows[2]]


def test_pipeline_of_awkward_and_empty(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (awkward, nothing):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == table.columns
        docs.count()
