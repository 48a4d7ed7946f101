"""Display text within a budget of bytes, shared fairly, and reads that shrink until they fit."""

from __future__ import annotations

from collections.abc import Callable

from rangeview.functions.display import SUFFIX
from rangeview.model import PreviewError, Range

DISPLAY_ONLY_BYTES = 16 << 10
PLACEHOLDER = "[Value exceeds the preview byte limit]"
#: Rows that a remembered limit never falls under.
LEAST_ROWS = 4


def cut(text: str, most: int) -> str:
    """Whole characters within ``most`` bytes of UTF-8, with the suffix if it fits."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    tail = SUFFIX if most >= len(SUFFIX) else ""
    return raw[: most - len(tail)].decode("utf-8", "ignore") + tail


def shared_out(columns: list[list[str | None]], total: int, cell: int = DISPLAY_ONLY_BYTES) -> list[list[str | None]]:
    """``columns`` of display texts within ``total`` bytes.

    A column may take the share of the rest that its texts are of all texts left, rounded up; within it a text may take
    the rest over the texts left, rounded up, and at most ``cell``. What one does not use goes to those after it.
    """
    counts = [sum(t is not None for t in c) for c in columns]
    left, texts, out = total, sum(counts), []
    for c, n in zip(columns, counts):
        room = -(-left * n // texts) if texts else 0
        spent, own, rest = 0, [], n
        for t in c:
            if t is not None:
                t = cut(t, min(cell, -(-(room - spent) // rest)))
                spent += len(t.encode())
                rest -= 1
            own.append(t)
        out.append(own)
        left, texts = left - spent, texts - n
    return out


class Adaptive:
    """Reads ranges, halving rows and then columns while a reader says RESOURCE_LIMIT; remembers the rows that fit."""

    def __init__(self, read: Callable[[Range], list[list]]):
        self.read, self.most_rows = read, None

    def rows(self, request: Range) -> list[list]:
        """The cells of the range, row by row; a cell that is too large on its own is the placeholder."""
        out: list[list] = []
        step = min(request.row_count, self.most_rows or request.row_count)
        at = request.row_start
        while at < request.row_start + request.row_count:
            n = min(step, request.row_start + request.row_count - at)
            try:
                out += self.read(Range(at, n, request.column_start, request.column_count))
                at += n
            except PreviewError as e:
                if e.code != "RESOURCE_LIMIT":
                    raise
                if n > 1:
                    step = max(1, n // 2)
                    self.most_rows = max(LEAST_ROWS, step)
                else:
                    out.append(self._row(Range(at, 1, request.column_start, request.column_count)))
                    at += 1
        return out

    def _row(self, one: Range) -> list:
        try:
            return list(self.read(one)[0])
        except PreviewError as e:
            if e.code != "RESOURCE_LIMIT":
                raise
            if one.column_count <= 1:
                return [PLACEHOLDER]
            half = one.column_count // 2
            return self._row(Range(one.row_start, 1, one.column_start, half)) + self._row(Range(one.row_start, 1, one.column_start + half, one.column_count - half))
