"""Indicators whose next value needs their previous output, as one grouped kernel per symbol.

All requested indicators run in a single pass over each symbol, so several cost one exchange and one Arrow round trip.
Inside a kernel na is NaN; columns come back with NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barframe.operators.frames import KEYS, Keys

NAN = float("nan")


class Ema:
    """alpha = 2 / (n + 1), seeded by the first value, standing still on na."""

    def __init__(self, n: int):
        self.a, self.y = 2.0 / (n + 1), NAN

    def __call__(self, x: float) -> float:
        if x == x:
            self.y = x if self.y != self.y else self.a * x + (1 - self.a) * self.y
        return self.y


class Rma:
    """Mean of the first n values, then (y (n - 1) + x) / n; na before, standing still on na."""

    def __init__(self, n: int):
        self.n, self.seen, self.total, self.y = n, 0, 0.0, NAN

    def __call__(self, x: float) -> float:
        if x == x:
            if self.seen < self.n:
                self.seen, self.total = self.seen + 1, self.total + x
                if self.seen == self.n:
                    self.y = self.total / self.n
            else:
                self.y = (self.y * (self.n - 1) + x) / self.n
        return self.y


def _each(f, *xs) -> np.ndarray:
    return np.array([f(*v) for v in zip(*(x.tolist() for x in xs))], float)


def ema(x, n: int):
    return _each(Ema(n), x)


def rma(x, n: int):
    return _each(Rma(n), x)


def rsi(x, n: int):
    up, down, last = Rma(n), Rma(n), NAN

    def step(v):
        nonlocal last
        if v != v:
            return NAN
        d, last = v - last, v
        u, w = up(max(d, 0.0) if d == d else NAN), down(max(-d, 0.0) if d == d else NAN)
        if u != u or w != w:
            return NAN
        return 100.0 if w == 0 else 100 - 100 / (1 + u / w)

    return _each(step, x)


def true_range(h, lo, c):
    """The first bar's range is high less low."""
    before = np.concatenate([[NAN], c[:-1]])
    wide = np.maximum(h - lo, np.maximum(np.abs(h - before), np.abs(lo - before)))
    return np.where(np.isnan(before), h - lo, wide)


def atr(h, lo, c, n: int):
    return rma(true_range(h, lo, c), n)


def macd(x, fast: int, slow: int, signal: int):
    line = ema(x, fast) - ema(x, slow)
    sig = ema(line, signal)
    return line, sig, line - sig


class Tsi:
    """Double smoothed change over double smoothed absolute change."""

    def __init__(self, short: int, long: int):
        self.up, self.all, self.last = (Ema(long), Ema(short)), (Ema(long), Ema(short)), NAN

    def __call__(self, v: float) -> float:
        if v != v:
            return NAN
        change, self.last = v - self.last, v
        if change != change:
            return NAN
        top, low = self.up[1](self.up[0](change)), self.all[1](self.all[0](abs(change)))
        return NAN if low == 0 else top / low


def tsi(x, short: int, long: int):
    return _each(Tsi(short, long), x)


def kc(x, h, lo, c, n: int, mult: float):
    mid, span = ema(x, n), ema(true_range(h, lo, c), n)
    return mid, mid + mult * span, mid - mult * span


def kcw(x, h, lo, c, n: int, mult: float):
    mid, up, low = kc(x, h, lo, c, n, mult)
    return np.where(mid == 0, NAN, (up - low) / np.where(mid == 0, 1, mid))


class Range:
    """True range; the first bar's is high less low."""

    def __init__(self):
        self.before = NAN

    def __call__(self, high: float, low: float, close: float) -> float:
        c, self.before = self.before, close
        return high - low if c != c else max(high - low, abs(high - c), abs(low - c))


class Supertrend:
    """Line and direction: -1 with the line below the price, 1 above."""

    def __init__(self, factor: float, n: int):
        self.factor, self.range, self.mean = factor, Range(), Rma(n)
        self.lower = self.upper = self.before = NAN
        self.way = 1

    def __call__(self, high: float, low: float, close: float) -> tuple[float, float]:
        w = self.factor * self.mean(self.range(high, low, close))
        a, b = (high + low) / 2 - w, (high + low) / 2 + w
        if self.before > self.lower:  # never true of na
            a = max(a, self.lower)
        if self.before < self.upper:
            b = min(b, self.upper)
        if w == w:
            self.way = (-1 if close > b else 1) if self.way == 1 else (1 if close < a else -1)
        self.lower, self.upper, self.before = a, b, close
        return (a if self.way == -1 else b), self.way


class Dmi:
    """The two directional lines and the smoothed index of their difference."""

    def __init__(self, di: int, adx: int):
        self.range, self.wide, self.plus, self.minus, self.smooth = Range(), Rma(di), Rma(di), Rma(di), Rma(adx)
        self.high = self.low = NAN

    def __call__(self, high: float, low: float, close: float) -> tuple[float, float, float]:
        up, down = high - self.high, self.low - low
        self.high, self.low = high, low
        r = self.wide(self.range(high, low, close))
        a, b = self.plus(up if up > down and up > 0 else 0.0), self.minus(down if down > up and down > 0 else 0.0)
        a, b = (0.0, 0.0) if r == 0 else (100 * a / r, 100 * b / r)
        return a, b, self.smooth(0.0 if a + b == 0 else 100 * abs(a - b) / (a + b))


class Sar:
    """Stop and reverse: na on the first bar, the trend of the second from its close, clamped by two bars."""

    def __init__(self, start: float, inc: float, top: float):
        self.start, self.inc, self.top = start, inc, top
        self.past: list[tuple[float, float, float]] = []  # high, low and close of the last two bars
        self.seen = 0

    def __call__(self, high: float, low: float, close: float) -> float:
        self.seen += 1
        y = NAN if self.seen == 1 else self._step(high, low, close)
        self.past = [*self.past[-1:], (high, low, close)]
        return y

    def _step(self, high: float, low: float, close: float) -> float:
        fresh = self.seen == 2
        if fresh:
            h0, l0, c0 = self.past[-1]
            self.below = close > c0
            self.extreme, self.y, self.speed = (high, l0, self.start) if self.below else (low, h0, self.start)
        y = self.y + self.speed * (self.extreme - self.y)
        if self.below and y > low:
            fresh, self.below, y, self.extreme, self.speed = True, False, max(high, self.extreme), low, self.start
        elif not self.below and y < high:
            fresh, self.below, y, self.extreme, self.speed = True, True, min(low, self.extreme), high, self.start
        if not fresh and (high > self.extreme if self.below else low < self.extreme):
            self.extreme, self.speed = (high if self.below else low), min(self.speed + self.inc, self.top)
        self.y = min(y, *[p[1] for p in self.past]) if self.below else max(y, *[p[0] for p in self.past])
        return self.y


def _columns(f, *xs) -> tuple[np.ndarray, ...]:
    return tuple(np.array([f(*v) for v in zip(*(x.tolist() for x in xs))], float).reshape(len(xs[0]), -1).T)


def supertrend(h, lo, c, factor: float, n: int):
    return _columns(Supertrend(factor, n), h, lo, c)


def dmi(h, lo, c, di: int, adx: int):
    return _columns(Dmi(di, adx), h, lo, c)


def sar(h, lo, c, start: float, inc: float, top: float):
    return _each(Sar(start, inc, top), h, lo, c)


HLC = ("high", "low", "close")
#: name: kernel, fixed inputs after a source, number of outputs, takes a source
KERNELS = {
    "ema": (ema, (), 1, True), "rma": (rma, (), 1, True), "rsi": (rsi, (), 1, True), "atr": (atr, HLC, 1, False),
    "macd": (macd, (), 3, True), "tsi": (tsi, (), 1, True), "kc": (kc, HLC, 3, True), "kcw": (kcw, HLC, 1, True),
    "supertrend": (supertrend, HLC, 2, False), "dmi": (dmi, HLC, 3, False), "sar": (sar, HLC, 1, False),
}


@dataclass(frozen=True)
class Call:
    """One indicator: the output columns' names, the kernel, its source column and literal parameters."""

    out: tuple[str, ...]
    kernel: str
    params: tuple = ()
    source: str | None = None
    inputs: tuple[str, ...] = field(default=())

    def columns(self) -> tuple[str, ...]:
        _, fixed, _, sourced = KERNELS[self.kernel]
        return ((self.source or "close",) if sourced else ()) + fixed


def with_recursive(df: DataFrame, calls: list[Call], k: Keys = KEYS) -> DataFrame:
    """``df`` with the outputs of all calls, in one grouped pass."""
    names = [o for c in calls for o in c.out]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    order = list(k.order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        new = {}
        for c in calls:
            f = KERNELS[c.kernel][0]
            got = f(*[rows[x].to_numpy(float) for x in c.columns()], *c.params)
            new |= dict(zip(c.out, got if isinstance(got, tuple) else (got,)))
        return rows.assign(**{n: v for n, v in new.items()})

    from barframe.na import clean

    out = df.groupBy(*k.by).applyInPandas(run, schema)
    return out.withColumns({n: clean(n) for n in names})
