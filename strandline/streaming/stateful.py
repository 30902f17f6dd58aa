"""Operators that carry state for a stream: hysteresis latch, transitions, contiguous runs.

Rows of a key that come in one batch are sorted by pos. A row whose pos is not above the last one seen for its key is late
or repeated and is dropped, so a replayed batch changes nothing. State is one small row a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _fresh(batches: Iterator[pd.DataFrame], last: int | None, pos: str) -> pd.DataFrame:
    rows = pd.concat(list(batches)).drop_duplicates(pos).sort_values(pos)
    return rows if last is None else rows[rows[pos] > last]


def _fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def latch_stream(df: DataFrame, part: str, pos: str, state_p: str, onset_p: str, release_p: str, on: float = 0.5, off: float = 0.5, start: float = 0.5, resync_on: float = 0.9, resync_off: float = 0.1, patience: int = 3) -> DataFrame:
    """part, pos, held: operators.sequence.latch() on a stream, with the held state carried over batches."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, against = state.get if state.exists else (None, None, 0)
        rows = _fresh(batches, last, pos)
        out = []
        for p, onset, release in zip(rows[state_p], rows[onset_p], rows[release_p]):
            if held is None:
                held = p >= start
            elif (release >= off) if held else (onset >= on):
                held, against = not held, 0
            elif (p <= resync_off) if held else (p >= resync_on):
                against += 1
                if against >= patience:
                    held, against = not held, 0
            else:
                against = 0
            out.append(bool(held))
        if len(rows):
            state.update((int(rows[pos].iloc[-1]), bool(held), against))
        yield pd.DataFrame({part: [key[0]] * len(rows), pos: rows[pos].to_numpy(), "held": out})

    return df.groupBy(part).applyInPandasWithState(step, f"{_fields(df, part, pos)}, held boolean", "last long, held boolean, against int", "append", GroupStateTimeout.NoTimeout)


def transition_stream(df: DataFrame, part: str, pos: str, flag: str) -> DataFrame:
    """part, pos, kind: onset or release where the flag differs from the row before, in this batch or an earlier one;
    a stream's first row is an onset if it is set."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, False)
        rows = _fresh(batches, last, pos)
        now = rows[flag].astype(bool)
        before = now.shift(1, fill_value=held)
        changed = rows[now != before]
        if len(rows):
            state.update((int(rows[pos].iloc[-1]), bool(now.iloc[-1])))
        kind = changed[flag].astype(bool).map({True: "onset", False: "release"})
        yield pd.DataFrame({part: [key[0]] * len(changed), pos: changed[pos].to_numpy(), "kind": kind.to_numpy(dtype=object)})

    return df.groupBy(part).applyInPandasWithState(step, f"{_fields(df, part, pos)}, kind string", "last long, held boolean", "append", GroupStateTimeout.NoTimeout)


def run_stream(df: DataFrame, part: str, pos: str, index: str) -> DataFrame:
    """part, pos, run_id: runs of rows whose index steps by exactly one, numbered from 1, across batches."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, run = state.get if state.exists else (None, None, 0)
        rows = _fresh(batches, last, pos)
        starts = rows[index].diff().ne(1)
        if len(rows):
            starts.iloc[0] = before is None or rows[index].iloc[0] - before != 1
        ids = run + starts.cumsum()
        if len(rows):
            state.update((int(rows[pos].iloc[-1]), int(rows[index].iloc[-1]), int(ids.iloc[-1])))
        yield pd.DataFrame({part: [key[0]] * len(rows), pos: rows[pos].to_numpy(), "run_id": ids.to_numpy("int64")})

    return df.groupBy(part).applyInPandasWithState(step, f"{_fields(df, part, pos)}, run_id long", "last long, before long, run long", "append", GroupStateTimeout.NoTimeout)


class _FrameRepeats(StatefulProcessor):
    """The state of frame_repeats(): one row of counts and the last frame, and a map of frames that came early."""

    COUNTS = ("frames", "pairs", "exact_pairs", "near_pairs", "run", "longest_exact_run")

    def __init__(self, part: str, pos: str, vector: str, near: float, first: int):
        self.names, self.near, self.first = (part, pos, vector), near, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getValueState("counted", ", ".join(f"{c} long" for c in self.COUNTS) + ", frame array<double>")
        self.early = handle.getMapState("early", "pos long", "frame array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part, pos, vector = self.names
        known = self.counted.get()
        counts = dict(zip((*self.COUNTS, "frame"), known, strict=True)) if known else {**dict.fromkeys(self.COUNTS, 0), "frame": None}
        before = counts["frames"]
        for batch in rows:
            for at, frame in zip(batch[pos], batch[vector], strict=True):
                place = int(at) - self.first
                if place == counts["frames"]:
                    self._take(counts, frame)
                    while self.early.containsKey((counts["frames"],)):
                        place = counts["frames"]
                        self._take(counts, self.early.getValue((place,))[0])
                        self.early.removeKey((place,))
                elif place > counts["frames"]:
                    self.early.updateValue((place,), ([float(x) for x in frame],))
        if counts["frames"] > before:
            self.counted.update((*(counts[c] for c in self.COUNTS), [float(x) for x in counts["frame"]]))
            shown = [c for c in self.COUNTS if c != "run"]
            yield pd.DataFrame({part: [key[0]], **{c: [counts[c]] for c in shown}})

    def _take(self, counts: dict[str, Any], frame: Any) -> None:
        now = np.asarray(frame, float)
        if counts["frame"] is not None:
            gap = np.abs(now - np.asarray(counts["frame"], float))
            exact = not gap.any()
            counts["pairs"] += 1
            counts["exact_pairs"] += exact
            counts["near_pairs"] += bool(gap.mean() <= self.near) if len(gap) else True
            counts["run"] = counts["run"] + 1 if exact else 0
            counts["longest_exact_run"] = max(counts["longest_exact_run"], counts["run"])
        counts["frames"] += 1
        counts["frame"] = now

    def close(self) -> None:
        pass


def frame_repeats(df: DataFrame, part: str, pos: str, vector: str, near: float, first: int = 0) -> DataFrame:
    """part, frames, pairs, exact_pairs, near_pairs, longest_exact_run: how often a frame (a vector) equals the one before it, or
    differs by at most `near` on average, over the frames of a stream from position `first` on without a hole so far.

    Frames come in chunks of any size, in any order, and may come again. The last frame is carried over chunks in keyed state; a frame that
    comes before its predecessors waits in a map of its own, so that state is read by position and never whole. A row is put out
    for a stream whenever its count of frames has grown (update mode); the one with the most frames is the
    latest. The result doesn't depend on how frames are cut into chunks. Needs the RocksDB state store."""
    kind = df.schema[part].dataType.simpleString()
    schema = f"`{part}` {kind}, frames long, pairs long, exact_pairs long, near_pairs long, longest_exact_run long"
    return df.select(part, pos, vector).groupBy(part).transformWithStateInPandas(_FrameRepeats(part, pos, vector, near, first), schema, "Update", "None")
