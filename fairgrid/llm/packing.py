"""Best-fit packing: a configuration linear program over the length histogram.

The program covers the count of every length by fill patterns (multisets of lengths that fit a sequence) with as
few patterns as possible. It is solved by multiplicative weights: each phase prices patterns by a knapsack dynamic
program over the capacity, adds the best pattern that holds each length, and lowers the weights of covered
lengths. The fractional counts are rounded under the true counts and the few pieces left over are packed best-fit.
All of this works on the histogram, which has at most ``capacity`` entries whatever the table's size; the pieces
themselves only get a rank among their length, from which sequence and offset follow in closed form.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm.common import documents, materialise, positions, rank_buckets
from fairgrid.llm.token_cache import piece_ids

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, pieces of it in a sequence), ...), sequences alike


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, sizes free to repeat, and the index of the size taken there (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], values[order]
    upto = np.searchsorted(small, np.arange(capacity + 1), "right")
    for c in range(int(small[0]), capacity + 1):
        n = upto[c]
        got = best[c - small[:n]] + worth[:n]
        k = n - 1 - int(np.argmax(got[::-1]))  # of equals the longest
        best[c], took[c] = got[k], order[k]
    return best, took


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, phases: int, slack: float) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional pattern counts that cover ``counts``, by multiplicative weights."""
    weight, covered = np.ones(len(sizes)), np.zeros(len(sizes))
    out: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    step = 1.0 / phases
    for _ in range(2 * phases):
        if covered.min() >= 1:
            break
        values = sizes / capacity * weight
        best, took = knapsack(sizes, values, capacity)
        worth = values + best[capacity - sizes]
        for i in np.flatnonzero((worth >= (1 - slack) * worth[covered < 1].max()) & (covered < 1)):
            if covered[i] >= 1:
                continue
            pattern: dict[int, int] = defaultdict(int)
            pattern[i] += 1
            room = capacity - int(sizes[i])
            while took[room] >= 0:
                pattern[int(took[room])] += 1
                room -= int(sizes[took[room]])
            inside = np.fromiter(pattern, np.int64)
            each = np.fromiter(pattern.values(), np.float64)
            amount = min(step * float(np.min(counts[inside] / each)), float((1 - covered[i]) * counts[i]) / pattern[i] + 1e-9)
            gained = amount * each / counts[inside]
            covered[inside] += gained
            weight[inside] *= np.exp(-gained)
            out[tuple(sorted((int(sizes[j]), n) for j, n in pattern.items()))] += amount
        weight[covered >= 1] *= 0.5
        weight /= weight.max()
    return out


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: equal sequences stay one entry, so the work doesn't grow with the counts."""
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(fill: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        if room not in by_room or not by_room[room]:
            insort(rooms, room)
        by_room[room].append((fill, n))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                fill, have = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(k)
                each = min(room // size, n)
                use = min(have, n // each)
                if have > use:
                    put(fill, room, have - use)
                put((*fill, (size, each)), room - each * size, use)
            else:
                each = min(capacity // size, n)
                use = n // each
                put(((size, each),), capacity - each * size, use)
            n -= use * each
    return [entry for entries in by_room.values() for entry in entries]


def plan_sequences(histogram: dict[int, int], capacity: int, phases: int = 24, slack: float = 0.02) -> Plan:
    """Patterns and how many sequences follow each, covering ``histogram`` (length to count) exactly."""
    left = {int(k): int(v) for k, v in histogram.items() if v and k}
    full = left.pop(capacity, 0)
    plan: Plan = [(((capacity, 1),), full)] if full else []
    sizes = np.array(sorted(left, reverse=True), np.int64)
    if len(sizes):
        counts = np.array([left[int(x)] for x in sizes], np.float64)
        amounts = configuration_lp(sizes, counts, capacity, phases, slack)
        # rounding: whole parts first, then fractions of a half and more, each within what is left, and only patterns that
        # waste no more than the tightest one with the same longest piece
        waste = {p: capacity - sum(size * n for size, n in p) for p in amounts}
        tightest: dict[int, int] = {}
        for pattern, spare in waste.items():
            tightest[pattern[-1][0]] = min(spare, tightest.get(pattern[-1][0], capacity))
        tight = [p for p in amounts if waste[p] <= tightest[p[-1][0]] + capacity // 2048]
        for whole in (True, False):
            for pattern in sorted(tight, key=lambda p: (-(amounts[p] if whole else amounts[p] % 1), p)):
                use = min(min(left[size] // n for size, n in pattern), int(amounts[pattern]) if whole else round(amounts[pattern] % 1))
                if use:
                    plan.append((pattern, use))
                    for size, n in pattern:
                        left[size] -= use * n
        plan += best_fit({k: v for k, v in left.items() if v}, capacity)
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, a materialised table of lengths from 1 to ``capacity``.

    ``order`` names columns that tell rows apart. Equal lengths, even a third of all rows, are ranked over many
    tasks. An empty table gives an empty result.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, pieces in each, place
    ranked: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in plan_sequences(histogram, capacity):
        place = 0
        for size, each in pattern:
            runs[size].append((ranked[size], sequence, each, place))
            ranked[size] += times * each
            place += size * each
        sequence += times
    table = {size: tuple(np.array(x, np.int64) for x in zip(*entries, strict=True)) for size, entries in runs.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        out = np.zeros((2, len(size)), np.int64)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            first, start, each, place = table[int(s)]
            k = np.searchsorted(first, rank[rows], "right") - 1
            inside = rank[rows] - first[k]
            out[0, rows] = start[k] + inside // each[k]
            out[1, rows] = place[k] + inside % each[k] * s
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    ranked_rows = positions(pieces, [length_col], order, "_rank", rank_buckets(sum(histogram.values())))
    return ranked_rows.withColumn("_at", placed(length_col, "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and ``end_id``, cut into pieces of ``capacity``: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    A null text counts as empty: one piece holding ``end_id``. Repeated rows give repeated pieces; a null doc_id stays null.
    """
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    fields += [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(tokenizer_path)
        for batch in batches:
            at = 0
            for ids, ends in encoder.of(batch.column(1)):
                rows: list[tuple] = []
                begin = 0
                for k, end in enumerate(ends):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((at + k, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                at += len(ends)
                columns = list(zip(*rows, strict=True))
                arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(x, f.type) for x, f in zip(columns[1:], fields, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f.name for f in fields)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs``; only ``doc_id`` and ``text`` are read, other columns may have any name."""
    pieces = materialise(encode_pieces(docs, tokenizer_path, capacity=capacity, with_ids=with_ids), "pieces")
    return pack(pieces, ["doc_id", "piece"], capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all ``documents``, 4096 tokens a sequence."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
