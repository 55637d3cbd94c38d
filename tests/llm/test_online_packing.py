"""Online packing against a plain search for the least sum of squares, and its pieces against the library's ids."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from fairgrid.llm import online_packing
from fairgrid.llm.online_packing import Windows
from tests.llm.conftest import AWKWARD
from tests.llm.test_tokens import library

LOWER = public_tokenizers.path("word_bpe_49k.json")


def least_squares(sizes, capacity):
    """The level that each size goes to, by trying every open window."""
    fills, levels = [], []

    def squares(fills):
        return sum(n * n for level, n in Counter(fills).items() if level < capacity)

    for size in sizes:
        tried = [(squares([*fills, size]), 0, None)]
        for k, fill in enumerate(fills):
            if fill < capacity and fill + size <= capacity:
                tried.append((squares([*fills[:k], fill + size, *fills[k + 1 :]]), -fill, k))
        _, level, k = min(tried, key=lambda x: x[:2])
        levels.append(-level)
        if k is None:
            fills.append(size)
        else:
            fills[k] += size
    return levels


@pytest.mark.parametrize("seed", range(20))
def test_levels_equal_a_plain_search(seed):
    random.seed(seed)
    capacity = random.choice([8, 13, 20])
    sizes = [random.randint(1, capacity - 1) for _ in range(120)] if seed % 2 else random.choices([2, 3, 5], k=120)
    windows, got = Windows(capacity, most_open=1000), []
    for size in sizes:
        got.append(windows.level_for(size))
        windows.add(0, np.zeros(size, np.uint32))
    assert got == least_squares(sizes, capacity)


def check(rows, capacity, want):
    """Pieces cover each document once, windows are gapless and full or a power of two."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for doc, start, ids, _, window, offset in rows:
        pieces[doc].append((start, list(ids)))
        windows[window].append((offset, len(ids)))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in pieces.items()} == want
    for own in pieces.values():
        assert [s for s, _ in sorted(own)] == list(np.cumsum([0] + [len(i) for _, i in sorted(own)])[:-1])
    short = []
    for own in windows.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1])
        fill = sum(n for _, n in own)
        assert fill <= capacity and (fill == capacity or fill & (fill - 1) == 0)
        short += [fill] * (fill < capacity)
    assert len(short) == len(set(short))


@pytest.mark.parametrize("sizes", [[], [1], [64], [33] * 500, [31, 33] * 200, [63] * 50, [200, 1, 64, 65], list(range(1, 200))])
@pytest.mark.parametrize("most_open", [1, 7, 1000])
def test_windows_are_full_and_bounded(sizes, most_open):
    windows, want = Windows(64, most_open), {}
    for doc, size in enumerate(sizes):
        want[doc] = list(range(doc * 1000, doc * 1000 + size))
        windows.add(doc, np.array(want[doc], np.uint32))
        assert len(windows.held) <= most_open
        assert sum(k * n for k, n in enumerate(windows.counts)) == sum(len(p[2]) for own in windows.held.values() for p in own)
    windows.finish()
    assert not windows.held and not windows.counts.any()
    check(windows.closed, 64, want)


def test_documents_of_the_tables(docs, awkward, nothing):
    for table in (docs, awkward):
        rows = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        whole = Counter((d, tuple([*ids, 1])) for (d, _), ids in zip(rows, library(LOWER, [t for _, t in rows]), strict=True))
        got = online_packing.pack_online(table.repartition(3), LOWER, with_ids=True).collect()
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) for r in got)
        assert Counter({d: n for d, n in Counter(r.doc_id for r in got for _ in range(r.length)).items()}) == Counter({d: sum(len(i) * n for (x, i), n in whole.items() if x == d) for d, _ in whole})
        lengths = Counter((d, len(i)) for (d, i), n in whole.items() for _ in range(n))
        assert all((r.doc_id, r.doc_tokens) in lengths for r in got)
        alone = {d for d, _ in whole if sum(n for (x, _), n in whole.items() if x == d) == 1}
        for doc_id in alone:
            own = sorted((r.start, r.ids) for r in got if r.doc_id == doc_id)
            assert (doc_id, tuple(x for _, ids in own for x in ids)) in whole
            assert [s for s, _ in own] == list(np.cumsum([0] + [len(i) for _, i in own])[:-1])
        fills = Counter()
        for r in got:
            fills[r.sequence_id] += r.length
        assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())
    assert online_packing.pack_online(nothing, LOWER).count() == 0
    assert len(AWKWARD) == awkward.count()
