"""Tags beside boxes: each where it covers nothing, as far as what was placed before it leaves room."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold

Rect = tuple[int, int, int, int]
CELL = 64
#: Up to so many boxes, a frame's rectangles are looked through one by one; more go to a grid.
FEW = 24


class _List:
    """Rectangles of which there are few."""

    def __init__(self) -> None:
        self.all: list[Rect] = []

    def add(self, r: Rect) -> None:
        self.all.append(r)

    def covered(self, r: Rect, but: Rect | None = None) -> int:
        """The areas that ``r`` shares with each rectangle, added up, those equal to ``but`` left out."""
        x0, y0, x1, y1 = r
        total = 0
        for o in self.all:
            a, b, c, d = o
            if a < x1 and x0 < c and b < y1 and y0 < d:
                w, h = (x1 if x1 < c else c) - (x0 if x0 > a else a), (y1 if y1 < d else d) - (y0 if y0 > b else b)
                if w > 0 and h > 0 and o != but:
                    total += w * h
        return total


class _Grid:
    """Rectangles by the cells they touch, so that what a small rectangle overlaps is found among its neighbours only."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], list[Rect]] = {}

    @staticmethod
    def touched(r: Rect) -> Iterator[tuple[int, int]]:
        for x in range(r[0] // CELL, max(r[2] - 1, r[0]) // CELL + 1):
            for y in range(r[1] // CELL, max(r[3] - 1, r[1]) // CELL + 1):
                yield x, y

    def add(self, r: Rect) -> None:
        for c in self.touched(r):
            self.cells.setdefault(c, []).append(r)

    def covered(self, r: Rect, but: Rect | None = None) -> int:
        """The areas that ``r`` shares with each rectangle, added up, those equal to ``but`` left out. A shared area counts in the cell of its upper left corner."""
        total = 0
        for c in self.touched(r):
            for o in self.cells.get(c, ()):
                x, y = max(r[0], o[0]), max(r[1], o[1])
                w, h = min(r[2], o[2]) - x, min(r[3], o[3]) - y
                if w > 0 and h > 0 and o != but and (x // CELL, y // CELL) == c:
                    total += w * h
        return total


class _Frame:
    """The boxes of a frame in order; once all are known, their tags are placed one after the other."""

    def __init__(self, width: int, height: int) -> None:
        self.width, self.height = width, height
        self.asked: list[tuple] = []

    def step(self, *box) -> tuple:
        self.asked.append(box)
        return ()

    def close(self) -> Iterator[tuple]:
        kind = _List if len(self.asked) <= FEW else _Grid
        boxes, tags = kind(), kind()
        for a in self.asked:
            boxes.add(a[2:6])
        for pos, box, x0, y0, x1, y1, tag_width, tag_height in self.asked:
            own = (x0, y0, x1, y1)
            right, low = self.width - tag_width, self.height - tag_height
            middle = (y0 + y1) // 2 - tag_height // 2
            best = None
            for x, y in ((x1 + 2, middle), (x0 - tag_width - 2, middle), (x0, y0 - tag_height - 1), (x0, y1 + 1)):
                x, y = min(max(x, 0), right), min(max(y, 0), low)
                tag = (x, y, x + tag_width, y + tag_height)
                alone = max(0, min(tag[2], x1) - max(x, x0)) * max(0, min(tag[3], y1) - max(y, y0))  # equal boxes count once
                over = alone + boxes.covered(tag, own) + tags.covered(tag, own)
                if best is None or over < best[0]:
                    best = over, tag
                if not over:
                    break
            over, tag = best
            tags.add(tag)
            yield pos, box, tag[0], tag[1], over > 0


def place_tags(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Where the tag of each box (frame, pos, box, bbox, tag_width, tag_height) goes: x, y and ``clash``.

    Boxes are taken in order of ``pos``. Right of the box, left, above or below, moved into the picture; the first place that overlaps no box and no tag placed
    before, else that of the least overlap, the earliest on a tie, which is a clash. Boxes without a whole rectangle have no tag. A frame's boxes are held, as numbers,
    until all are known; where there are many, their rectangles go to a grid.
    """
    corners = ("x0", "y0", "x1", "y1")
    rows = boxes.select("frame", "pos", "box", *[F.col("bbox")[c].alias(c) for c in corners], "tag_width", "tag_height").dropna(subset=corners)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pos", "box")}
    return fold(rows, ["frame"], ["pos", "box"], partial(_Frame, width, height), f"pos {kinds['pos']}, box {kinds['box']}, x int, y int, clash boolean")
