"""Token ids of whole texts from a public tokenizer, each distinct piece encoded once per worker.

A text is cut only where both sides encode independently of each other. Texts of ASCII and Latin-1 letters are cut in
arrays between runs of letters, digits, marks and white space; every other text goes to the library as it is. Pieces
are numbered by Arrow's dictionary encoding, looked up in a bounded table, and those not seen before go to the
library's batch call in batches of equal bytes. Very long texts are first split at spaces that follow an ASCII mark,
letter or digit: neither tokenizer family joins across such a point, and strings of special tokens hold no space.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fairgrid.llm.common import worker_table

#: Kinds of bytes: a space, other white space, letters (with the bytes of À to ÿ), digits, marks, and bytes whose texts go to the library.
SPACE, WHITE, LETTER, DIGIT, MARK, ODD = range(6)
KINDS = np.full(256, MARK, np.uint8)
KINDS[0x80:] = ODD
KINDS[0x80:0xC0] = LETTER
KINDS[0xC3] = LETTER
for _first, _last, _kind in ((0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x30, 0x39, DIGIT), (0x09, 0x0A, WHITE), (0x0D, 0x0D, WHITE), (0x20, 0x20, SPACE), (0x0B, 0x0C, ODD), (0x1C, 0x1F, ODD)):
    KINDS[_first : _last + 1] = _kind
#: Longer pieces are encoded each time.
LONGEST = 64
#: Ids kept for pieces at most.
MOST_IDS = 4_000_000


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of string ``texts`` without nulls, one after another, and the offsets of the texts in them."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """String array over ``data``, cut at ``offsets``."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def flattened(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``pool[start : start + count]`` of each pair, one after another."""
    totals = np.cumsum(counts)
    return pool[np.arange(int(totals[-1]) if len(totals) else 0) + np.repeat(starts - totals + counts, counts)]


def segments(texts: pa.Array, size: int) -> tuple[pa.Array, np.ndarray]:
    """``texts`` with those over ``2 * size`` bytes split at safe spaces, and for each part whether its text ends with it."""
    data, offsets = flat_bytes(texts)
    long = np.flatnonzero(np.diff(offsets) > 2 * size)
    if not len(long):
        return texts, np.ones(len(texts), bool)
    cuts = []
    for k in long:
        own = data[offsets[k] : offsets[k + 1]]
        at = size
        while at < len(own) - size:
            near = own[at - 1 : at + size]
            safe = np.flatnonzero((near[1:] == 0x20) & (near[:-1] > 0x20) & (near[:-1] < 0x7F))
            if len(safe):
                cuts.append(int(offsets[k]) + at + int(safe[0]))
                at += int(safe[0])
            at += size
    every = np.concatenate([offsets, np.array(cuts, np.int64)])
    last = np.concatenate([np.ones(len(offsets), bool), np.zeros(len(cuts), bool)])
    order = np.argsort(every, kind="stable")
    return strings(data, every[order]), last[order][1:]


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold other characters than ASCII and À to ÿ, rare white space, or what may begin a special token."""
    kinds = KINDS[data]
    bad = kinds == ODD
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    high = data >= 0x80
    if high.any():
        trail = high & (data < 0xC0)
        bad |= trail & (before != 0xC3)
        bad |= trail & ((data == 0x97) | (data == 0xB7))
    bad |= (data == 0x7C) & (before == 0x3C)  # <|
    counts = np.concatenate([[0], np.cumsum(bad)])
    return np.diff(counts[offsets]) > 0


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that aren't odd.

    White space goes with what follows it, but a single line end or tab is a piece of its own; an apostrophe goes with
    the letters after it.
    """
    kinds = KINDS[data]
    white = kinds <= WHITE
    before = np.full(len(data), MARK, np.uint8)
    before[1:] = kinds[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start = white & (before > WHITE)
    start |= ~white & (before > WHITE) & (kinds != before)
    letters = np.flatnonzero(start & (kinds == LETTER))
    start[letters[data[letters - 1] == 0x27]] = False
    start[firsts] = True
    lone = np.flatnonzero(start & (kinds == WHITE))
    lone = lone[lone + 1 < len(data)] + 1
    start[lone[~white[lone]]] = True
    return np.flatnonzero(start)


class PieceIds:
    """Ids of pieces, as unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = 300_000, batch_bytes: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.entries, self.batch_bytes = entries, batch_bytes
        #: With a lower-casing tokenizer, ASCII letters are lower-cased before look-up.
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bounds = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a word, or else that start one
        self.ends = bool(suffix)
        self.bounds[[i for token, i in ids.items() if (token.endswith(suffix) if suffix else token.startswith("Ġ"))]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each text, by the library's batch call."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for own in found for i in own], np.uint32), counts

    def _batched(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same in batches of about ``batch_bytes``."""
        _, offsets = flat_bytes(texts)
        told, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.batch_bytes, "right")) - 1)
            told.append(self._each(texts.slice(at, stop - at).to_pylist()))
            at = stop
        return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in told)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in told)])

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces.

        Letters after one space are sent joined, a few thousand bytes at a time, and their ids told apart by the
        tokens that end or start a word; where the numbers don't agree, and for other pieces, each is a text.
        """
        data, offsets = flat_bytes(pieces)
        plain = (KINDS[data] == LETTER).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(plain)])
        sizes = np.diff(offsets)
        joined = (np.diff(sums[offsets]) == sizes - 1) & (sizes > 1) & (data[np.minimum(offsets[:-1], max(0, len(data) - 1))] == 0x20)
        runs = pieces.filter(pa.array(joined))
        run_data, run_offsets = flat_bytes(runs)
        at = np.unique(np.searchsorted(run_offsets, np.arange(0, len(run_data) + 4096, 4096), "left").clip(0, len(runs)))
        ids, counts = self._batched(strings(run_data, run_offsets[at]) if len(at) > 1 else pa.array([], pa.string()))
        marks = np.flatnonzero(self.bounds[ids])
        per_text = np.add.reduceat(self.bounds[ids].astype(np.int64), np.cumsum(counts) - counts) if len(ids) else np.zeros(0, np.int64)
        if np.array_equal(per_text, np.diff(at) if len(ids) else per_text) and len(marks) == len(runs):
            cuts = np.concatenate([[0], marks + 1]) if self.ends else np.concatenate([marks, [len(ids)]])
        else:
            joined[:] = False
            ids, cuts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        alone, alone_counts = self._batched(pieces.filter(pa.array(~joined)))
        out = np.zeros(len(pieces), np.int64)
        out[joined], out[~joined] = np.diff(cuts), alone_counts
        starts = np.zeros(len(pieces), np.int64)
        starts[joined], starts[~joined] = cuts[:-1], len(ids) + np.cumsum(alone_counts) - alone_counts
        return flattened(np.concatenate([ids, alone]), starts, out), out

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Places in the table of distinct pieces, which takes in those that it lacks."""
        if len(self.known) > self.entries or len(self.pool) > MOST_IDS:
            self._clear()
        codes = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = codes < 0
        if lacking.any():
            fresh = pieces.filter(pa.array(lacking))
            ids, counts = self._encode(fresh)
            codes[lacking] = len(self.starts) + np.arange(len(fresh))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.pool = np.concatenate([self.pool, ids])
            long = pc.greater(pc.binary_length(fresh), LONGEST)
            # a long piece keeps its place but not its text
            self.known = pa.concat_arrays([self.known, pc.if_else(long, None, fresh)])
        return codes

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield ``(ids, ends)`` of consecutive groups of texts, balanced by bytes; a text's ids end at its end. Null: none."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            limit = (sizes[start - 1] if start else 0) + 16 * self.batch_bytes
            stop = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
            parts, last = segments(texts.slice(start, stop - start), 4 * self.batch_bytes)
            if len(parts) == stop - start:
                yield self._group(parts)
            else:  # a very long text: its parts one at a time
                told = [self._group(parts.slice(k, 1)) for k in range(len(parts))]
                yield np.concatenate([x for x, _ in told]), np.cumsum([n[-1] for _, n in told])[last]
            start = stop

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = flat_bytes(texts)
        odd = odd_texts(data, offsets)
        counts = np.zeros(len(texts), np.int64)
        odd_ids, counts[odd] = self._batched(texts.filter(pa.array(odd))) if odd.any() else (np.zeros(0, np.uint32), 0)
        usual = texts.filter(pa.array(~odd)) if odd.any() else texts
        data, offsets = flat_bytes(pc.ascii_lower(usual) if self.lower else usual)
        at = piece_starts(data, offsets)
        found = strings(data, np.append(at, len(data))).dictionary_encode()
        codes = self._codes(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
        pieces = self.counts[codes]
        before = np.concatenate([[0], np.cumsum(pieces)])
        counts[~odd] = np.diff(before[np.searchsorted(at, offsets)])
        ids = flattened(self.pool, self.starts[codes], pieces)
        ends = np.cumsum(counts)
        if odd.any():
            of_odd = np.repeat(odd, counts)
            both = np.empty(int(ends[-1]), np.uint32)
            both[of_odd], both[~of_odd] = odd_ids, ids
            ids = both
        return ids, ends


def piece_ids(path: str) -> PieceIds:
    """One per Python worker and tokenizer: workers are reused from task to task."""
    return worker_table(("piece-ids", path), lambda: PieceIds(path))
