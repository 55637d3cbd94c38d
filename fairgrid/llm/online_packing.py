"""Sum-of-squares online packing: each document goes, as it comes, into one of the windows that are open.

An array holds how many windows are filled to each level. A document goes to the level (or into a new window) that
leaves the sum of the squares of these counts least, so windows that only a rare length could close don't pile up.
Every task packs its own documents in one pass and holds its open windows alone, a bounded number of them; windows
too many, and those left at the end, are poured into the fullest ones, which cuts the documents in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from fairgrid.llm.common import documents, materialise
from fairgrid.llm.token_cache import piece_ids

#: A piece: its document, the document's ids before it, its ids, the document's number of ids.
Piece = tuple[object, int, np.ndarray, int]


class Windows:
    """The open windows of one task. ``closed`` takes ``(doc, start, ids, doc_tokens, window, offset)`` of pieces of closed windows."""

    def __init__(self, capacity: int = 2048, most_open: int = 2048, first_window: int = 0):
        self.capacity, self.most_open, self.next = capacity, most_open, first_window
        self.counts = np.zeros(capacity + 1, np.int64)  # of open windows at each level; 0 and the capacity stay empty
        self.at: list[list[int]] = [[] for _ in range(capacity)]  # the windows at each level
        self.held: dict[int, list[Piece]] = {}
        self.closed: list[tuple[object, int, np.ndarray, int, int, int]] = []

    def level_for(self, size: int) -> int:
        """The level that a piece of ``size`` goes to, 0 for a new window: the least sum of squares, of equals the fullest level."""
        last = self.capacity - size
        before, after = self.counts[: last + 1], self.counts[size : self.capacity + 1]
        change = 2 * (after - before) + 2  # one window less at a level, one more at another
        change[last] -= 1 + 2 * after[last]  # full windows aren't counted
        change[before == 0] = np.iinfo(np.int64).max
        change[0] = 2 * after[0] + 1 if last else 0
        return last - int(np.argmin(change[::-1]))

    def add(self, doc: object, ids: np.ndarray) -> None:
        """Pack one document: whole windows of a long one first, then its rest by the sum of squares."""
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self.closed.append((doc, start, ids[start : start + self.capacity], len(ids), self.next, 0))
            self.next += 1
        if whole < len(ids):
            level = self.level_for(len(ids) - whole)
            self._put((doc, whole, ids[whole:].copy(), len(ids)), self._take(level) if level else None, level)
            while len(self.held) > self.most_open:
                self.pour()

    def _take(self, level: int) -> int:
        self.counts[level] -= 1
        return self.at[level].pop()

    def _put(self, piece: Piece, window: int | None, level: int) -> None:
        """Add to a window that was taken from its level, or to a new one."""
        if window is None:
            window, self.next = self.next, self.next + 1
            self.held[window] = []
        self.held[window].append(piece)
        level += len(piece[2])
        if level == self.capacity:
            self._close(window)
        else:
            self.counts[level] += 1
            self.at[level].append(window)

    def _close(self, window: int) -> None:
        offset = 0
        for doc, start, ids, total in self.held.pop(window):
            self.closed.append((doc, start, ids, total, window, offset))
            offset += len(ids)

    def pour(self) -> None:
        """Empty the emptiest window into the fullest ones, cutting its pieces where they fill one."""
        levels = np.flatnonzero(self.counts)
        donor = self._take(int(levels[0]))
        for doc, start, ids, total in self.held.pop(donor):
            while len(ids):
                open_levels = np.flatnonzero(self.counts)
                level = int(open_levels[-1]) if len(open_levels) else 0
                part, ids = ids[: self.capacity - level], ids[self.capacity - level :]
                self._put((doc, start, part, total), self._take(level) if level else None, level)
                start += len(part)

    def finish(self) -> None:
        """Pour until one window is left, and cut that one into windows whose lengths are powers of two, which need no padding."""
        while len(self.held) > 1:
            self.pour()
        for window in list(self.held):
            pieces = self.held.pop(window)
            left = sum(len(p[2]) for p in pieces)
            self.counts[left] -= 1
            self.at[left].pop()
            room, offset = 1 << (left.bit_length() - 1), 0
            for doc, start, ids, total in pieces:
                while len(ids):
                    part, ids = ids[: room - offset], ids[room - offset :]
                    self.closed.append((doc, start, part, total, window, offset))
                    start, offset, left = start + len(part), offset + len(part), left - len(part)
                    if offset == room and left:
                        window, self.next = self.next, self.next + 1
                        room, offset = 1 << (left.bit_length() - 1), 0


def pack_online(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, most_open: int = 2048, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and ``end_id``, packed: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]``.

    Each id lies in exactly one piece, and windows are full, but for at most one a power of two long for each power
    below ``capacity`` and task. A task holds ``most_open`` windows at most. A null text counts as empty: a document
    of ``end_id`` alone. A very long text gives whole windows and a rest. Repeated rows are documents of their own, a
    null doc_id stays null, equal lengths are packed in the order they come; other columns are not read. An empty
    table gives an empty result. The result is written once, so a lost executor can't change windows already read.
    """
    import pyarrow.compute as pc

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows, kind = piece_ids(tokenizer_path), Windows(capacity, most_open, TaskContext.get().partitionId() << 40), None

        def told() -> pa.RecordBatch:
            rows, windows.closed = windows.closed, []
            parts = [r[2].astype("<u4", copy=False) for r in rows]
            arrays = [pa.array([r[0] for r in rows], kind), *(pa.array(x, pa.int64()) for x in ([r[1] for r in rows], list(map(len, parts)), list(map(zlib.crc32, parts)), *([r[k] for r in rows] for k in (3, 4, 5))))]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))] * with_ids, names=names)

        for batch in batches:
            kind, owners, at = batch.schema.field(0).type, batch.column(0).to_pylist(), 0
            for ids, ends in encoder.of(pc.fill_null(batch.column(1), "")):
                begin = 0
                for end in ends:
                    windows.add(owners[at], np.append(ids[begin:end], np.uint32(end_id)))
                    begin, at = end, at + 1
                yield told()
        if kind is not None:
            windows.finish()
            yield told()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return materialise(docs.select("doc_id", "text").mapInArrow(pack, schema), "online-pieces")


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all ``documents``, 2048 tokens a sequence."""
    import public_tokenizers

    return pack_online(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
