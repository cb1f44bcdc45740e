"""Settling of a stream of pictures, with cursors that blink told from content that changes.

A picture is a list of shapes: rectangles with a value. Two pictures differ in the rectangles whose value differs. A rectangle that toggles with a steady
period in one place is a blinker: ``Blinkers`` matches rectangles online by their intersection over union and forgets what stops. ``Pictures`` settles as
``settle.Settle`` does, but

* what blinkers and narrow bars change is no motion;
* a change that is over and new is not emitted while all that is new may still turn out to be a blinker: the emission waits, and is withdrawn if it does;
* once a blinker is known, times that its toggles have moved are set back to the last real motion;
* a state carries its caret: the blinker that was active in its interval, the latest if there were several.

Samples of a key come in order of time. Repeated samples change nothing, null pictures are empty, a null value is a value of its own, ties in time go by
the order that the driver sorts them in. Of shapes with one rectangle the last counts.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold
from ..session import prepare

Rect = tuple[int, int, int, int]
STATE = "t_change double, t_settled double, t_end double, settled boolean, n_shapes int, caret array<int>"
SPOT = "t double, rect array<int>, blinks boolean, confirmed_at double"


@dataclass(frozen=True)
class Rules:
    """Times in seconds, sizes in pixels."""

    still: float = 0.4
    hold: float = 3.0
    alike: float = 0.5
    largest: tuple[int, int] = (40, 40)
    shortest: float = 0.2
    longest: float = 0.8
    within: float = 4.0
    recurrences: int = 2
    forget: float = 2.0
    bar: tuple[int, int, int] = (3, 8, 60)
    area: int = 12
    toggles: int = 64


def alike(a: Rect, b: Rect) -> float:
    """Intersection over union."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (size(a) + size(b) - both) if both else 0.0


def size(a: Rect) -> int:
    return (a[2] - a[0]) * (a[3] - a[1])


@dataclass
class Spot:
    """A place where something small has changed, and when."""

    rect: Rect
    seen: float
    toggles: deque
    since: float | None = None


class Blinkers:
    """Spots of one stream. Holds live spots, and of confirmed ones that stopped the interval they were seen in."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.spots, self.past = rules, [], deque(maxlen=2048)

    def at(self, rect: Rect) -> Spot | None:
        near = [(alike(s.rect, rect), -k) for k, s in enumerate(self.spots)]
        best = max(near, default=(0.0, 0))
        return self.spots[-best[1]] if best[0] >= self.rules.alike else None

    def observe(self, rects: list[Rect], t: float) -> tuple[set[int], list[Spot]]:
        """Which of ``rects`` are toggles of confirmed blinkers, and the blinkers that this sample confirms."""
        explained, fresh, r = set(), [], self.rules
        for k, rect in enumerate(rects):
            if rect[2] - rect[0] > r.largest[0] or rect[3] - rect[1] > r.largest[1]:
                continue
            spot = self.at(rect)
            if spot is None:
                self.spots.append(Spot(rect, t, deque([t], r.toggles)))
                continue
            pause, spot.seen = t - spot.toggles[-1], t
            if pause >= r.shortest:
                if pause > r.longest:  # too late to be the same rhythm
                    spot.toggles.clear()
                    spot.since = None
                spot.toggles.append(t)
                spot.rect = rect
                if spot.since is None and sum(t - x <= r.within for x in spot.toggles) > r.recurrences:
                    spot.since = t
                    fresh.append(spot)
            if spot.since is not None:
                explained.add(k)
        self.past.extend((s.rect, s.toggles[0], s.seen) for s in self.spots if t - s.seen > r.forget and s.since is not None)
        self.spots = [s for s in self.spots if t - s.seen <= r.forget]
        return explained, fresh

    def known(self, rect: Rect) -> bool:
        spot = self.at(rect)
        return spot is not None and spot.since is not None

    def may_be(self, rect: Rect, t: float) -> bool:
        """Whether a spot is here that isn't confirmed and may still recur."""
        spot = self.at(rect)
        return spot is not None and spot.since is None and t - spot.toggles[-1] <= self.rules.longest

    def caret(self, begin: float, end: float) -> Rect | None:
        live = [(s.rect, s.toggles[0], s.seen) for s in self.spots if s.since is not None]
        inside = [(min(last, end), -k, rect) for k, (rect, first, last) in enumerate([*live, *self.past]) if first <= end and last >= begin]
        return max(inside)[2] if inside else None


@dataclass
class Pictures:
    """The settling machine of one key."""

    rules: Rules = field(default_factory=Rules)

    def __post_init__(self) -> None:
        self.blinkers = Blinkers(self.rules)
        self.before: tuple[float, dict] | None = None
        self.shown: dict = {}  # the picture of the last state
        self.open: list | None = None  # its t_change, t_settled, settled, shapes
        self.emitted = 0.0
        self.change: float | None = None
        self.quiet: float | None = None
        self.motion: deque = deque()

    def _content(self, rects: list[Rect]) -> list[Rect]:
        w, low, high = self.rules.bar
        return [x for x in rects if not (x[2] - x[0] <= w and low <= x[3] - x[1] <= high)]

    def _new(self, picture: dict, t: float) -> tuple[bool, bool]:
        """Whether a picture shows something new, and whether all of that may be a blinker yet."""
        rects = [x for x in self._content(differing(self.shown, picture)) if not self.blinkers.known(x)]
        new = sum(map(size, rects)) >= self.rules.area
        return new, new and all(self.blinkers.may_be(x, t) for x in rects)

    def _show(self, picture: dict, t: float, change: float, settled_at: float, settled: bool) -> list[tuple]:
        out = self._end(change)
        self.open, self.shown, self.emitted = [change, max(settled_at, change), settled, len(picture)], picture, t
        return out

    def _end(self, end: float) -> list[tuple]:
        if self.open is None:
            return []
        change, at, settled, n = self.open
        self.open = None
        end = max(end, at)
        rect = self.blinkers.caret(at, end)
        return [(change, at, end, settled, n, list(rect) if rect else None)]

    def step(self, t: float, shapes: list[dict] | None) -> list[tuple]:
        picture = {(s["x0"], s["y0"], s["x1"], s["y1"]): s["v"] for s in shapes or ()}
        if self.before is None:
            self.before = t, picture
            return self._show(picture, t, t, t, True)
        r, out = self.rules, []
        rects = differing(self.before[1], picture)
        explained, fresh = self.blinkers.observe(rects, t)
        active = self._content([x for k, x in enumerate(rects) if k not in explained])
        moving = sum(map(size, active)) >= r.area
        self.motion.append((t, active if moving else []))
        while t - self.motion[0][0] > r.within:
            self.motion.popleft()
        if moving:
            self.change, self.quiet = t if self.change is None else self.change, None
        elif self.change is not None:
            self.quiet = self.before[0] if self.quiet is None else self.quiet
            if t - self.quiet >= r.still:
                new, wait = self._new(picture, t)
                if new and not wait:
                    out += self._show(picture, t, self.change, self.quiet, True)
                elif not new and not self.open[2]:
                    self.open[1:3] = max(self.quiet, self.open[0]), True
                if not wait:
                    self.change = None
        if self.change is not None and self.quiet is None and min(t - self.change, t - self.emitted) >= r.hold - 1e-9:
            out += self._show(picture, t, max(self.change, self.emitted), t, False)
            self.change = t
        for spot in fresh:
            real = next((at for at, moved in reversed(self.motion) if any(alike(x, spot.rect) < r.alike for x in moved)), None)
            if real is None:
                continue
            if self.change is not None and (self.quiet is None or real < self.quiet):
                self.quiet = max(real, self.change)
            if self.open and real < self.open[1] and any(abs(self.open[1] - x) < 1e-9 for x in spot.toggles):
                self.open[1] = max(real, self.open[0])
        self.before = t, picture
        return out

    def close(self) -> list[tuple]:
        """End of the stream, at the last sample."""
        if self.before is None:
            return []
        t, picture = self.before
        out = []
        just_shown = self.quiet is None and t - self.emitted < self.rules.still
        if self.change is not None and not just_shown and self._new(picture, t)[0]:
            out += self._show(picture, t, self.change, t if self.quiet is None else self.quiet, self.quiet is not None)
        return out + self._end(t)


def differing(a: dict, b: dict) -> list[Rect]:
    """Rectangles whose value differs, in order."""
    return sorted(x for x in a.keys() | b.keys() if (x in a, a.get(x)) != (x in b, b.get(x)))


class Spots:
    """A machine that says of each rectangle whether it is a toggle of a blinker."""

    def __init__(self, rules: Rules) -> None:
        self.blinkers, self.now, self.held = Blinkers(rules), None, []

    def step(self, t: float, rect: dict) -> list[tuple]:
        out = []
        if t != self.now:
            out, self.now, self.held = self.close(), t, []
        self.held.append((rect["x0"], rect["y0"], rect["x1"], rect["y1"]))
        return out

    def close(self) -> list[tuple]:
        explained, _ = self.blinkers.observe(self.held, self.now) if self.held else (set(), [])
        return [(self.now, list(x), k in explained, self.blinkers.at(x).since if k in explained else None) for k, x in enumerate(self.held)]


def blinks(rects: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Of changed rectangles (key, t, rect), which belong to a blinker, and since when it is known. A sample is all rows of a key and time."""
    rows = rects.select("key", "t", "rect")
    return fold(rows, ["key"], ["t", "rect"], lambda: Spots(rules), SPOT)


def settled_pictures(samples: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """States of all keys of samples (key, t, shapes)."""
    return fold(samples.select("key", "t", "shapes"), ["key"], ["t", "shapes"], lambda: Pictures(rules), STATE)


def settled_stream(samples: DataFrame, rules: Rules = Rules(), quiet: float = 600.0) -> DataFrame:
    """States of a stream of samples with a watermarked event time ``ts`` beside key, t and shapes; a key silent for ``quiet`` seconds ends.

    The state of a key is one picture or two, live spots and the motion of the last ``within`` seconds. Replayed in order it gives what ``settled_pictures`` gives.
    """

    def frame(key: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key, *r) for r in rows], columns=["key", *(x.split()[0] for x in STATE.split(", "))])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Pictures(rules)
        if state.hasTimedOut:
            yield frame(key[0], machine.close())
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = [r for t, shapes in zip(rows["t"], rows["shapes"]) for r in machine.step(float(t), [dict(zip(("x0", "y0", "x1", "y1", "v"), s.values() if isinstance(s, dict) else s)) for s in ([] if shapes is None else shapes)])]
        state.update((pickle.dumps(machine),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(quiet * 1000))
        yield frame(key[0], out)

    prepare(samples.sparkSession)
    return samples.groupBy("key").applyInPandasWithState(run, f"key string, {STATE}", "machine binary", "append", GroupStateTimeout.EventTimeTimeout)
