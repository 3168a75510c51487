"""Pages by cursor (O1-O3): the next page starts after the last row seen.

A page by offset sorts and skips all rows before it. A page by cursor filters on the sort
columns, so the bound on the first of them reaches the scan and row groups before it are not
read, and the top-k holds one page. Rows that arrive between two pages shift nothing.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Order = Sequence[tuple[str, str]]          # (column, "asc" or "desc"), nulls last in both


def ordering(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in order]


def cursor_of(row: Row, order: Order) -> dict:
    """The cursor of a page's last row."""
    return {c: row[c] for c, _ in order}


def after(order: Order, cursor: dict) -> Column:
    """Rows strictly after the cursor in the given order."""
    rest = F.lit(False)
    for c, way in reversed(list(order)):
        v = cursor[c]
        if v is None:
            beyond, same = F.lit(False), F.col(c).isNull()
        else:
            beyond = (F.col(c) < F.lit(v) if way == "desc" else F.col(c) > F.lit(v)) | F.col(c).isNull()
            same = F.col(c) == F.lit(v)
        rest = beyond | (same & rest)
    first, way = order[0]
    v = cursor[first]
    if v is None:
        return F.col(first).isNull() & rest
    bound = F.col(first) <= F.lit(v) if way == "desc" else F.col(first) >= F.lit(v)
    return (bound | F.col(first).isNull()) & rest


def page(rows: DataFrame, order: Order, limit: int, cursor: dict | None = None) -> DataFrame:
    """The first ``limit`` rows, or those after the cursor. The order must end in a unique column."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    if cursor is not None:
        rows = rows.filter(after(order, cursor))
    return rows.orderBy(*ordering(order)).limit(limit)
