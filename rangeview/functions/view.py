"""What a grid view works out: navigation, merged selections, visible ranges, places on a sparse axis."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeview.model import MAX_RANGE_CELLS, PreviewError

#: Rows and columns beyond the visible ones that are read too.
OVERSCAN_ROWS, OVERSCAN_COLUMNS = 8, 1
# The commands, each with the step of row and column (in cells, pages for ``page``) or the edge it goes to.
STEPS = {"left": (0, -1), "right": (0, 1), "up": (-1, 0), "down": (1, 0), "page-up": ("page", -1), "page-down": ("page", 1)}
EDGES = {"row-start": (None, 0), "row-end": (None, -1), "table-start": (0, None), "table-end": (-1, None)}
COMMANDS = (*STEPS, *EDGES)


def moved(row: Column, column: Column, command: Column, rows: int, columns: int, page: int = 1) -> Column:
    """The cell (row, column) that a navigation command leads to, within the table; null in an empty table."""
    if not rows or not columns:
        return F.lit(None).cast("struct<row:bigint,column:bigint>")
    inside = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    r, c = inside(row.cast("long"), rows), inside(column.cast("long"), columns)
    step = max(1, int(page))
    to_row = F.when(command == "up", r - 1).when(command == "down", r + 1).when(command == "page-up", r - step).when(command == "page-down", r + step).when(command == "table-start", 0).when(command == "table-end", rows - 1)
    to_column = F.when(command == "left", c - 1).when(command == "right", c + 1).when(command == "row-start", 0).when(command == "row-end", columns - 1)
    known = command.isin(*COMMANDS)
    return F.when(known, F.struct(inside(F.coalesce(to_row, r), rows).cast("long").alias("row"), inside(F.coalesce(to_column, c), columns).cast("long").alias("column")))


Rect = tuple[int, int, int, int]


def meets(a: Rect, b: Rect) -> bool:
    """Whether two half-open rectangles (row_start, row_end, column_start, column_end) share a cell."""
    return a[0] < b[1] and b[0] < a[1] and a[2] < b[3] and b[2] < a[3]


def contains(rect: Rect, row: int, column: int) -> bool:
    return rect[0] <= row < rect[1] and rect[2] <= column < rect[3]


def clamped_rect(rect: Rect, rows: int, columns: int) -> Rect | None:
    """The part of a rectangle inside a table, None if there is none."""
    out = max(rect[0], 0), min(rect[1], rows), max(rect[2], 0), min(rect[3], columns)
    return out if out[0] < out[1] and out[2] < out[3] else None


def expanded(rect: Rect, merges: Iterable[Rect]) -> Rect:
    """The least rectangle that holds ``rect`` and every merged region it meets, those it meets by growing included."""
    left = list(merges)
    while True:
        hit = [m for m in left if meets(rect, m)]
        if not hit:
            return rect
        left = [m for m in left if not meets(rect, m)]
        rect = min(rect[0], *(m[0] for m in hit)), max(rect[1], *(m[1] for m in hit)), min(rect[2], *(m[2] for m in hit)), max(rect[3], *(m[3] for m in hit))


class Axis:
    """Sizes along one axis: a default, and overrides (index, size, hidden); hidden places have no size."""

    def __init__(self, count: int, default: float, overrides: Iterable[tuple[int, float | None, bool]] = ()):
        self.count, self.default = count, default
        sizes = {i: 0.0 if hidden else default if size is None else float(size) for i, size, hidden in overrides if 0 <= i < count}
        self.index = sorted(sizes)
        self.sizes = [sizes[i] for i in self.index]
        self.before = [0.0]
        for s in self.sizes:
            self.before.append(self.before[-1] + s - default)

    def size(self, i: int) -> float:
        k = bisect_right(self.index, i) - 1
        return self.sizes[k] if k >= 0 and self.index[k] == i else self.default

    def position(self, i: int) -> float:
        """Where place ``i`` begins."""
        return i * self.default + self.before[bisect_right(self.index, i - 1)]

    def total(self) -> float:
        return self.position(self.count)

    def at(self, offset: float) -> int | None:
        """The visible place at an offset, the nearest one for offsets outside; None if nothing is visible."""
        low, high = 0, self.count
        while low < high:
            middle = (low + high) // 2
            if self.position(middle + 1) > offset:
                high = middle
            else:
                low = middle + 1
        return self.next_visible(min(low, self.count - 1), -1 if low >= self.count else 1) if self.count else None

    def next_visible(self, i: int, step: int = 1) -> int | None:
        """The first place from ``i`` on, in the direction of ``step``, that has a size."""
        while 0 <= i < self.count:
            if self.size(i) > 0:
                return i
            i += step
        return None

    def visible(self, offset: float, length: float) -> tuple[int, int]:
        """The half-open run of places that a view of ``length`` from ``offset`` shows."""
        if length <= 0 or (first := self.at(offset)) is None:
            return 0, 0
        last = self.at(offset + length)
        if last > first and self.position(last) >= offset + length:
            last = self.next_visible(last - 1, -1)
        return first, last + 1


def planned(rows: tuple[int, int], columns: tuple[int, int], row_total: int, column_total: int, frozen: tuple[int, int] = (0, 0), merges: Iterable[Rect] = (), max_cells: int = MAX_RANGE_CELLS) -> list[Rect]:
    """The rectangles a view reads: frozen and scrolling rows by frozen and scrolling columns, then the anchors of merged
    regions that begin outside them. The scrolling band is widened by the overscan if all of it still fits; a view that
    is over the limit even without is RESOURCE_LIMIT."""

    def bands(run, fixed, total, more):
        scrolling = max(run[0] - more, fixed), min(run[1] + more, total)
        return [b for b in ((0, min(fixed, total)), scrolling) if b[0] < b[1]]

    for over_rows, over_columns in ((OVERSCAN_ROWS, OVERSCAN_COLUMNS), (0, 0)):
        rects = [(*r, *c) for r in bands(rows, frozen[0], row_total, over_rows) for c in bands(columns, frozen[1], column_total, over_columns)]
        if sum((r[1] - r[0]) * (r[3] - r[2]) for r in rects) <= max_cells:
            break
    else:
        raise PreviewError("RESOURCE_LIMIT", f"a view holds at most {max_cells} cells")
    anchors = {(m[0], m[2]) for m in merges if any(meets(m, r) for r in rects) and not any(contains(r, m[0], m[2]) for r in rects)}
    return rects + [(r, r + 1, c, c + 1) for r, c in sorted(anchors)]
