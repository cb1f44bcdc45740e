"""Settling a stream of samples into states, by one state class with a batch and a streaming driver.

A sample is (key, t, digest). The first sample of a key is a state. A sample that differs from the one before starts a change;
once nothing has changed for ``still`` seconds the change is over, and is a new state if it differs from the last state emitted. A change
that goes on for ``hold`` seconds gives an unsettled snapshot, never two within ``hold``; if it then settles on what the snapshot
showed, the snapshot becomes settled. A state ends when the next begins.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import prepare

STATE = "key string, t_change double, t_settled double, t_end double, settled boolean, digest string"
_COLUMNS = [x.split()[0] for x in STATE.split(", ")]


@dataclass
class State:
    t_change: float
    t_settled: float
    settled: bool
    digest: str


@dataclass
class Settle:
    still: float = 0.4
    hold: float = 3.0
    seen: tuple[float, str] | None = None
    last: State | None = None
    change: float | None = None
    quiet: float | None = None
    emitted: float = float("-inf")
    done: list[tuple] = field(default_factory=list)

    def _emit(self, state: State, now: float) -> None:
        if self.last:
            self._close(state.t_change)
        self.last, self.emitted = state, now

    def _close(self, end: float) -> None:
        s = self.last
        self.done.append((s.t_change, s.t_settled, end, s.settled, s.digest))

    def step(self, t: float, digest: str) -> None:
        if self.seen is None:
            self._emit(State(t, t, True, digest), t)
        elif digest != self.seen[1]:
            self.change = t if self.change is None else self.change
            self.quiet = None
        elif self.change is not None:
            self.quiet = self.seen[0] if self.quiet is None else self.quiet
            if t - self.quiet >= self.still:
                if digest != self.last.digest:
                    self._emit(State(self.change, self.quiet, True, digest), t)
                elif not self.last.settled:
                    self.last.settled, self.last.t_settled = True, self.quiet
                self.change = self.quiet = None
        if self.change is not None and self.quiet is None and t - self.change >= self.hold and t - self.emitted >= self.hold and digest != self.last.digest:
            self._emit(State(self.change, t, False, digest), t)
            self.change = t
        self.seen = t, digest

    def finish(self, end: float) -> None:
        """End of the stream: a change that shows something new is a state, and the last state ends."""
        if self.last is None:
            return
        if self.change is not None and self.seen[1] != self.last.digest:
            self._emit(State(self.change, self.seen[0], False, self.seen[1]), end)
        self._close(max(end, self.last.t_settled))
        self.last = None

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def settle(samples: DataFrame, still: float, hold: float) -> DataFrame:
    """States of all keys. Keys are dealt over tasks and sorted by time there; a task streams through them with the state of one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            out = []
            for k, t, digest in pdf.itertuples(index=False, name=None):
                if machine is None or k != key:
                    if machine:
                        machine.finish(machine.seen[0])
                        out += [(key, *s) for s in machine.take()]
                    key, machine = k, Settle(still, hold)
                machine.step(t, digest)
                out += [(key, *s) for s in machine.take()]
            yield _frame(out)
        if machine:
            machine.finish(machine.seen[0])
            yield _frame([(key, *s) for s in machine.take()])

    prepare(samples.sparkSession)
    ordered = samples.select("key", "t", "digest").repartition("key").sortWithinPartitions("key", "t", "digest")
    return ordered.mapInPandas(run, STATE)


def settle_stream(samples: DataFrame, still: float, hold: float, quiet: float = 600.0) -> DataFrame:
    """States of a stream with columns key, t, digest and a watermarked event time ``ts``; a key silent for ``quiet`` seconds is finished.

    Rows later than the watermark never reach the state. Replayed in order it gives what ``settle`` gives.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Settle(still, hold)
        if state.hasTimedOut:
            machine.finish(machine.seen[0])
            yield _frame([(key[0], *s) for s in machine.take()])
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "digest"])
        for t, digest in rows[["t", "digest"]].itertuples(index=False, name=None):
            machine.step(t, digest)
        done = machine.take()
        state.update((pickle.dumps(machine),))
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(quiet * 1000))
        yield _frame([(key[0], *s) for s in done])

    prepare(samples.sparkSession)
    return samples.groupBy("key").applyInPandasWithState(run, STATE, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)
