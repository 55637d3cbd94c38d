"""Rate limits whose window starts with a key's first request, over whole logs.

Each window's start depends on the one before it, so a key's requests form a chain. Cut into chunks of time, a chunk
can be entered at its first requests only: from each of them the chain's way out of the chunk is found without
knowing what came before. A fold over these few entries tells where each chunk is really entered, and the chunks are
then replayed side by side. A key with any number of requests is shared out over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgrid.session import ship_package

#: Later than any request.
NEVER = np.iinfo(np.int64).max


def chain_ends(times: np.ndarray, window: int) -> np.ndarray:
    """For each of sorted ``times``, the last window start of the chain that starts there."""
    jump = np.searchsorted(times, times + window, "left")
    at = np.where(jump < len(times), jump, np.arange(len(times)))
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return times[at]
        at = further


def chain_starts(times: np.ndarray, first: int, window: int) -> np.ndarray:
    """The window starts from ``first`` on among sorted ``times``."""
    out, at = [], int(np.searchsorted(times, first, "left"))
    while at < len(times):
        out.append(times[at])
        at = int(np.searchsorted(times, times[at] + window, "left"))
    return np.array(out, np.int64)


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of frames sorted by ``_key, _chunk``, and where its groups start and stop; a group that a frame's end cuts goes on in the next."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame])
        starts = _starts(frame)
        held = frame.iloc[starts[-1] :]
        if len(starts) > 1:
            yield {c: frame[c].to_numpy() for c in frame}, starts[:-1], starts[1:]
    if held is not None:
        yield {c: held[c].to_numpy() for c in held}, np.zeros(1, np.int64), np.array([len(held)])


def _starts(frame: pd.DataFrame) -> np.ndarray:
    key, chunk = frame["_key"].to_numpy(), frame["_chunk"].to_numpy()
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))


def window_starts(rows: DataFrame, key: str, ts: str, seconds: int = 60, chunk_seconds: int = 3600) -> DataFrame:
    """``_key, _us, window_start``: for each distinct key and time in microseconds the start of the window it falls in.

    A key's first request opens a window of ``seconds``, the first request after its end the next one. ``_key`` is the
    key as text, null as ``unknown``. Rows without a time take no part. A chunk of a key must fit a task;
    ``chunk_seconds`` must be ``seconds`` at least.
    """
    if chunk_seconds < seconds:
        raise ValueError("a chunk is shorter than a window")
    ship_package(rows.sparkSession)
    window, chunk = seconds * 1_000_000, chunk_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    spots = rows.where(F.col(ts).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("_key"), us.alias("_us")).distinct()
    spots = spots.withColumn("_chunk", F.floor(F.col("_us") / chunk)).repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_us")

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for columns, starts, stops in _groups(frames):
            taken, ends = [], []
            for start, stop in zip(starts, stops, strict=True):
                times = columns["_us"][start:stop]
                few = min(stop - start, int(np.searchsorted(times, columns["_chunk"][start] * chunk + window, "left")) + 1)
                taken.append(np.arange(start, start + few))
                ends.append(chain_ends(times, window)[:few] + window)
            at = np.concatenate(taken)
            yield pd.DataFrame({"_key": columns["_key"][at], "_chunk": columns["_chunk"][at], "_us": columns["_us"][at], "_end": np.concatenate(ends)})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each chunk the first entry that no window covers, NEVER without one, and the window that is open before it."""
        name, at, end, entered = None, None, None, True
        for frame in frames:
            out = []
            for own, chunk_at, time, leaves in frame[["_key", "_chunk", "_us", "_end"]].itertuples(index=False):
                if (own, chunk_at) != (name, at):
                    if not entered:
                        out.append((name, at, NEVER, end - window))
                    end = end if own == name else None
                    name, at, entered = own, chunk_at, False
                if not entered and (end is None or time >= end):
                    out.append((name, at, time, time if end is None else end - window))
                    entered, end = True, leaves
            yield pd.DataFrame(out, columns=["_key", "_chunk", "_first", "_before"])
        if not entered:
            yield pd.DataFrame([(name, at, NEVER, end - window)], columns=["_key", "_chunk", "_first", "_before"])

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for columns, starts, stops in _groups(frames):
            out = []
            for start, stop in zip(starts, stops, strict=True):
                times = columns["_us"][start:stop]
                opened = np.append(columns["_before"][start], chain_starts(times, int(columns["_first"][start]), window))
                out.append(opened[np.searchsorted(opened[1:], times, "right")])
            rows = slice(starts[0], stops[-1])
            yield pd.DataFrame({"_key": columns["_key"][rows], "_us": columns["_us"][rows], "window_start": np.concatenate(out)})

    told = spots.mapInPandas(entries, "_key string, _chunk long, _us long, _end long")
    entered = told.repartition("_key").sortWithinPartitions("_key", "_us").mapInPandas(fold, "_key string, _chunk long, _first long, _before long")
    joined = spots.join(entered, ["_key", "_chunk"]).repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_us")
    return joined.mapInPandas(replay, "_key string, _us long, window_start long")


def limited(rows: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int = 60, chunk_seconds: int = 3600) -> DataFrame:
    """Add ``allowed``: whether a row is among the first ``limit``, by ``ts`` and ``order``, of its key's window; null without a time."""
    starts = window_starts(rows, key, ts, seconds, chunk_seconds)
    keyed = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("unknown"))).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ranked = keyed.join(starts, ["_key", "_us"], "left")
    rank = F.row_number().over(Window.partitionBy("_key", "window_start").orderBy("_us", order))
    return ranked.withColumn("allowed", F.when(F.col("_us").isNotNull(), rank <= limit)).select(*rows.columns, "allowed")
