"""Requests, extents, results, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SAFE_INTEGER = 2**53 - 1
MAX_RANGE_CELLS = 250_000
MAX_ROW_ARRAY_CELLS = 10_000
MAX_NESTING = 64
# The stable error codes.
CODES = (
    "INVALID_ARGUMENT", "INVALID_RANGE", "PARSE_FAILED", "RESOURCE_LIMIT", "UNSUPPORTED_FEATURE", "RANGE_NOT_INDEXED",
    "HANDLE_CLOSED", "CANCELLED", "INTERNAL", "SOURCE_UNAVAILABLE", "SOURCE_CHANGED", "RANGE_UNSUPPORTED",
)


class PreviewError(Exception):
    """An error with one of the stable codes."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details


@dataclass(frozen=True)
class Extent:
    """exact: all of it is known; at-least: a scan is under way; unknown."""

    kind: str
    value: int | None = None


@dataclass(frozen=True)
class Range:
    row_start: int
    row_count: int
    column_start: int
    column_count: int

    def checked(self, max_cells: int = MAX_RANGE_CELLS) -> Range:
        """Itself, if all four are safe non-negative integers and neither an axis nor the area is over the limit."""
        for name, v in vars(self).items():
            if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= SAFE_INTEGER:
                raise PreviewError("INVALID_RANGE", f"{name} must be an integer from 0 to 2^53 - 1")
        if self.row_start + self.row_count > SAFE_INTEGER or self.column_start + self.column_count > SAFE_INTEGER:
            raise PreviewError("INVALID_RANGE", "the end of the range is not a safe integer")
        if max(self.row_count, self.column_count, self.row_count * self.column_count) > max_cells:
            raise PreviewError("RESOURCE_LIMIT", f"a range holds at most {max_cells} cells")
        return self


def clamped(request: Range, rows: int, columns: int, policy: str) -> tuple[Range, bool]:
    """(returned range, complete). columnar sources clamp both axes and refuse a start past the end; record sources
    (delimited, excel) clamp rows only, give no rows past the end, and refuse columns past the schema."""
    if policy == "columnar":
        if request.row_start > rows or request.column_start > columns:
            raise PreviewError("INVALID_RANGE", "the range starts past the end of the table")
        got = Range(request.row_start, min(request.row_count, rows - request.row_start), request.column_start, min(request.column_count, columns - request.column_start))
        return got, got == request
    if request.column_start + request.column_count > columns:
        raise PreviewError("INVALID_RANGE", "the range ends past the last column")
    got = Range(request.row_start, max(0, min(request.row_count, rows - request.row_start)), request.column_start, request.column_count)
    return got, got.row_count == request.row_count


@dataclass
class RangeResult:
    df: DataFrame
    returned: Range
    complete: bool
    names: list[str] = field(default_factory=list)

    def rows(self, max_cells: int = MAX_ROW_ARRAY_CELLS) -> list[tuple]:
        """The rows as tuples, if the range has at most ``max_cells`` cells."""
        if self.returned.row_count * self.returned.column_count > max_cells:
            raise PreviewError("RESOURCE_LIMIT", f"at most {max_cells} cells can be read as rows")
        return [tuple(r) for r in self.df.collect()]


def budget(total_bytes: int) -> dict[str, int]:
    """How a memory budget is shared out: 75 % work, 12.5 % cache, 12.5 % in transit."""
    eighth = total_bytes // 8
    return {"work": total_bytes - 2 * eighth, "cache": eighth, "transit": eighth}
