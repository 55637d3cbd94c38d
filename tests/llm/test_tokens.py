"""Language ID, token counts, dropout encoding and packing."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fairgrid.llm import langid, packing, piece_dropout, token_counts
from fairgrid.llm.token_cache import PieceIds
from tests.llm.conftest import AWKWARD

BYTES, LOWER, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, LOWER])
def test_cut_ids_equal_the_library(path):
    random.seed(5)
    letters = list(" \n\t.,'|<>aZé1\x1c\x85 ́ΣİK×÷Éñ_-\r\x0b\x00¿«strel")
    texts = ["", "<|endoftext|> x<|endoftext|>y", "<|STARTOFTEXT|>", "it's I'LL", "x" * 300, "ΑΣ ΑΣ. İstanbul", "a\r\nb", " a b" * 5000, "é" * 9000 + " x", "日本 x" * 3000] + ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(4000)]
    got, encoder = [], PieceIds(path, entries=500, batch_bytes=2000)
    for ids, ends in encoder.of(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == library(path, texts)


def test_counts_of_awkward_rows(awkward, nothing):
    got = token_counts.count_tokens(awkward, BYTES, limit=5).collect()
    want = Counter((i, len((t or "").encode()), n, n > 5) for (i, t, _), n in zip(AWKWARD, map(len, library(BYTES, [t or "" for _, t, _ in AWKWARD])), strict=True))
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(nothing, BYTES).count() == 0


def test_packing_keeps_every_piece(docs, awkward, nothing):
    for table in (docs, awkward):
        rows = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        want = Counter()
        for (doc_id, _), ids in zip(rows, library(LOWER, [t for _, t in rows]), strict=True):
            ids = [*ids, 1]
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = ids[start : start + 4096]
                want[(doc_id, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
        got = packing.pack_documents(table, LOWER).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(nothing, LOWER).count() == 0


@pytest.mark.parametrize("lengths", [[], [10], [4096, 4096], [2049] * 9, [1365] * 30 + [1366] * 30, list(range(1, 4097, 3)), [2048, 2048, 1, 4095] * 500, [3000] * 100 + [1096] * 100 + [7] * 11])
def test_plan_covers_and_is_tight(lengths):
    plan = packing.plan_sequences(Counter(lengths), 4096)
    got = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= 4096
        for s, n in pattern:
            got[s] += n * times
    assert got == Counter(lengths)
    best = sum(times for _, times in packing.best_fit(Counter(lengths), 4096))
    assert sum(times for _, times in plan) <= best + 1


def test_knapsack_against_all_fills():
    sizes, values = np.array([7, 5, 3]), np.array([0.9, 0.5, 0.31])
    best, _ = packing.knapsack(sizes, values, 20)
    assert best[20] == pytest.approx(max(a * 0.9 + b * 0.5 + c * 0.31 for a in range(3) for b in range(5) for c in range(7) if 7 * a + 5 * b + 3 * c <= 20))


def test_dropout_round_trip_and_draws(spark, awkward, docs, nothing):
    encoded = piece_dropout.encode_dropout(awkward, PIECES, rate=0.3, seed=4)
    back = piece_dropout.decode_ids(encoded, PIECES).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, _ in AWKWARD)
    assert sorted(map(str, encoded.collect())) == sorted(map(str, piece_dropout.encode_dropout(awkward.repartition(5), PIECES, rate=0.3, seed=4).collect()))
    first = {r.doc_id: r.ids for r in piece_dropout.encode_dropout(docs, PIECES, rate=0.3, seed=4).collect()}
    second = {r.doc_id: r.ids for r in piece_dropout.encode_dropout(docs, PIECES, rate=0.3, seed=5).collect()}
    assert sum(first[k] != second[k] for k in first) > 0.9 * len(first)
    assert piece_dropout.encode_dropout(nothing, PIECES).count() == 0 and piece_dropout.round_trip(nothing, PIECES).count() == 0
    told = {r.doc_id: tuple(r)[1:] for r in piece_dropout.round_trip(docs, PIECES, rate=0.3, seed=4).collect()}
    for r in docs.collect():
        own = first[r.doc_id]
        assert told[r.doc_id] == (len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), zlib.crc32((r.text or "").encode()))


def encode_one(encoder, text, doc_id=0):
    ids, _ = encoder.encode(pa.array([text]), np.array([encoder.key(doc_id, text)], np.uint64))
    return ids.tolist()


def test_no_dropout_is_the_library(docs):
    encoder = piece_dropout.DropoutEncoder(PIECES, 0.0, 0)
    random.seed(2)
    letters = list(" \n\t.,'<|aZé1 日本\U0001f600thein&*İ")
    texts = [r.text or "" for r in docs.collect()] + ["", "  a", "a  ", "x" * 300, "日本" * 100] + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(3000)]
    ids, ends = encoder.encode(pa.array(texts), np.zeros(len(texts), np.uint64))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [encoder.library.encode(t) for t in texts]


def test_dropout_draws_each_occurrence():
    times = 3000
    encoder = piece_dropout.DropoutEncoder(PIECES, 0.1, 7)
    text = " ".join(["international"] * times)
    got = encode_one(encoder, text)
    assert encoder.library.decode(got) == text
    pieces = Counter("|".join(map(encoder.library.id_to_piece, got)).replace("|▁", "\n▁").split("\n"))
    assert sum(pieces.values()) == times and len(pieces) > 20
    _, seen = encoder.segment_one(np.array([*map(ord, " international")], np.uint32), iter([piece_dropout.NEVER]))
    clean = (1 - 0.1) ** seen  # no candidate skipped; other draws can lead to the same pieces
    assert pieces["▁international"] / times > clean - 4 * (clean * (1 - clean) / times) ** 0.5
    assert max(v for k, v in pieces.items() if k != "▁international") < times / 4
    # the same text under other ids, and without kept segmentations
    assert len({tuple(encode_one(encoder, "international", k)) for k in range(200)}) > 4
    assert encode_one(piece_dropout.DropoutEncoder(PIECES, 0.1, 7, entries=0), text) == got


def by_strings(encoder, word, skips):
    """The agenda told plainly: all candidates in a list, the best and leftmost one first."""
    rank = {p: k for k, p in enumerate(encoder.pieces)}
    symbols, seen, live = list(word.replace(" ", "▁")), 0, {}

    def meet(at):
        nonlocal seen
        union = symbols[at] + symbols[at + 1]
        live[at] = None
        if union in rank:
            live[at] = None if seen in skips else rank[union]
            seen += 1

    for at in range(len(symbols) - 1):
        meet(at)
    while any(v is not None for v in live.values()):
        at = min((v, k) for k, v in live.items() if v is not None)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        live = {k - (k > at): v for k, v in live.items() if k not in (at, len(symbols))} | ({len(symbols) - 1: live[len(symbols)]} if len(symbols) in live and len(symbols) - 1 > at else {})
        live.pop(len(symbols) - 1, None)
        for k in (at - 1, at):
            if 0 <= k < len(symbols) - 1:
                meet(k)
    return symbols, seen


def test_dropout_against_brute_force():
    """Many fragments at once and one by one with a heap, against the agenda over strings."""
    random.seed(3)
    encoder = piece_dropout.DropoutEncoder(PIECES, 0.2, 7)
    words = ["".join(random.choices("theinsoar ", k=random.randint(1, piece_dropout.LONG))) for _ in range(400)]
    encoder.letters.extend(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
    counts = np.array([len(w) for w in words])
    skips = np.sort(np.array([random.sample(range(40), 3) for _ in words]), axis=1)
    symbols, numbers, seen = encoder.segment_many(np.cumsum(counts) - counts, counts, skips)
    for word, own, n, row in zip(words, np.split(symbols, np.cumsum(numbers)[:-1]), seen.tolist(), skips.tolist()):
        assert ([encoder.pieces[k] for k in own], n) == by_strings(encoder, word, row)
        assert encoder.segment_one(np.array([*map(ord, word)], np.uint32), iter([*row, piece_dropout.NEVER])) == (own.tolist(), n)


def test_decoding_is_the_library():
    decoder = piece_dropout.Decoder(PIECES)
    random.seed(4)
    rows = [[random.randrange(40 if k % 3 else 32000) for _ in range(random.randint(0, 12))] for k in range(2000)]
    got = decoder.decode(np.array([i for r in rows for i in r], np.int64), np.cumsum([len(r) for r in rows]))
    assert got == [decoder.library.decode(r) for r in rows]


def test_language_held_out(spark, small):
    got = langid.op1_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").collect()
    assert len(got) == 200
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_rejects_gibberish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    held = {lang: [r.text for r in docs.where(langid.id_crc() % 3 == 1).where(f"lang = '{lang}'").orderBy("doc_id").limit(40).collect()] for lang in ("en", "de", "fr", "es")}
    random.seed(11)
    words = lambda n: " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(n))
    texts = {"clean": sum(held.values(), []), "gibberish 50": [words(50) for _ in range(100)], "gibberish 300": [words(300) for _ in range(100)]}
    texts["mixed"] = [f"{a[:1000]} {b[:1000]}" for x, y in (("en", "de"), ("fr", "es"), ("de", "es")) for a, b in zip(held[x], held[y])]
    kinds = [(kind, text) for kind, own in texts.items() for text in own]
    got = langid.identify(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(kinds)], "doc_id long, text string"), model).collect()
    rejected, margins = {k: [] for k in texts}, {k: [] for k in texts}
    for r in got:
        rejected[kinds[r.doc_id][0]].append(r.rejected)
        margins[kinds[r.doc_id][0]].append(r.margin)
    share = {k: sum(x) / len(x) for k, x in rejected.items()}
    print(model.margin, {k: (len(x), round(share[k], 3), round(float(np.mean(np.array(margins[k]) < 0.001)), 3), round(float(np.median(margins[k])), 4)) for k, x in rejected.items()})
    assert share["clean"] <= 0.02 and share["gibberish 50"] >= 0.9 and share["gibberish 300"] >= 0.9
    assert share["mixed"] <= 0.5  # most have a language that leads: they are told, not rejected


def test_language_of_awkward_rows(awkward, nothing):
    model = langid.fit(awkward)
    got = langid.identify(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (2, 3, 4, 5, -5):
            assert r.lang_pred == "und" and r.rejected
        elif r.doc_id:
            assert r.lang_pred in ("en", "de", "fr")
    blank = langid.fit(nothing)
    assert langid.identify(nothing, blank).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward, blank).collect()} == {"und"}
