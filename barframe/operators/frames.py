"""Window frames of the indicator classes. Every frame counts rows and trails.

V: only rows with a value enter the frame, a row without one gives na. B: a row without a value takes a place and is
skipped. N: one missing value in the frame makes it na. C: cumulative from the first bar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Keys:
    """Partition and order of a bar table."""

    by: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("time",)

    def bars(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int, skip: int = 0) -> WindowSpec:
        return self.bars().rowsBetween(-(n - 1) - skip, -skip)

    def upto(self) -> WindowSpec:
        return self.bars().rowsBetween(Window.unboundedPreceding, 0)

    def valid(self, ok: Column) -> WindowSpec:
        return Window.partitionBy(*self.by, ok).orderBy(*self.order)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.bars())

    def index(self) -> Column:
        return F.row_number().over(self.bars()) - 1


KEYS = Keys()


def v_frame(x: Column, n: int, agg, k: Keys = KEYS, ok: Column | None = None) -> Column:
    """``agg(window)`` over the last n valid rows, na until there are n and on rows without a value."""
    ok = x.isNotNull() if ok is None else ok
    w = k.valid(ok).rowsBetween(-(n - 1), 0)
    return F.when(ok & (F.count(F.lit(1)).over(w) == n), agg(w))


def b_frame(n: int, agg, k: Keys = KEYS) -> Column:
    w = k.last(n)
    return F.when(F.count(F.lit(1)).over(w) == n, agg(w))


def n_frame(x: Column, n: int, agg, k: Keys = KEYS) -> Column:
    w = k.last(n)
    return F.when(F.count(x).over(w) == n, agg(w))
