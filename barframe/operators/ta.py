"""Stateless, lagged, windowed and cumulative indicators as Column expressions.

Each takes Columns (or names) and literal lengths and gives a Column over the bars of a symbol in time order; all share
one partitioning, so Catalyst sorts once. Indicators whose next value needs their previous output are in ``recursive``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barframe.na import col, div
from barframe.operators.frames import KEYS, Keys, b_frame, n_frame, v_frame


def _ohlcv() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def hl2() -> Column:
    return (F.col("high") + F.col("low")) / 2


def hlc3() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def ohlc4() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def hlcc4() -> Column:
    return (F.col("high") + F.col("low") + 2 * F.col("close")) / 4


# --- valid-row windows


def sma(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.avg(x).over(w), k)


def sum_(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.sum(x).over(w), k)


def stdev(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.stddev_pop(x).over(w), k)


def variance(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.var_pop(x).over(w), k)


def median(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.percentile(x, 0.5).over(w), k)


def range_(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return v_frame(x, n, lambda w: F.max(x).over(w) - F.min(x).over(w), k)


def _weighted(x: Column, n: int, weights: list[float], k: Keys, scale: float | None = None) -> Column:
    """Sum of the last n values, oldest first, times literal weights."""
    total = scale if scale is not None else sum(weights)
    ws = F.array(*[F.lit(float(v)) for v in weights])
    return v_frame(x, n, lambda w: F.aggregate(F.zip_with(F.collect_list(x).over(w), ws, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / total, k)


def wma(x, n: int, k: Keys = KEYS) -> Column:
    return _weighted(col(x), n, list(range(1, n + 1)), k)


def alma(x, n: int, offset: float = 0.85, sigma: float = 6.0, k: Keys = KEYS) -> Column:
    m, s = offset * (n - 1), n / sigma
    return _weighted(col(x), n, [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)], k)


def hma(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return wma(2 * wma(x, n // 2, k) - wma(x, n, k), round(math.sqrt(n)), k)


def dev(x, n: int, k: Keys = KEYS) -> Column:
    """Mean absolute deviation from the window's mean."""
    x = col(x)

    def agg(w):
        values, mean = F.collect_list(x).over(w), F.avg(x).over(w)
        return F.aggregate(F.zip_with(values, F.array_repeat(mean, n), lambda v, m: F.abs(v - m)), F.lit(0.0), lambda s, v: s + v) / n

    return v_frame(x, n, agg, k)


def cci(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.when(dev(x, n, k) == 0, F.lit(0.0)).otherwise((x - sma(x, n, k)) / (0.015 * dev(x, n, k))))


def cog(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    weights = F.array(*[F.lit(float(v)) for v in range(n, 0, -1)])

    def agg(w):
        top = F.aggregate(F.zip_with(F.collect_list(x).over(w), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return div(-top, F.sum(x).over(w))

    return v_frame(x, n, agg, k)


def correlation(a, b, n: int, k: Keys = KEYS) -> Column:
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    return v_frame(a, n, lambda w: div(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), k, both)


def linreg(x, n: int, offset: int = 0, k: Keys = KEYS) -> Column:
    x = col(x)
    i = F.row_number().over(k.valid(x.isNotNull())).cast("double")
    if n == 1:
        return x
    # least squares against the row number, around the window's means
    def agg(w):
        slope = div(F.covar_pop(i, x).over(w), F.var_pop(i).over(w))
        return F.avg(x).over(w) + slope * (i - offset - F.avg(i).over(w))

    return v_frame(x, n, agg, k)


def vwma(x, n: int, k: Keys = KEYS) -> Column:
    x, v = col(x), F.col("volume")
    both = x.isNotNull() & v.isNotNull()
    return v_frame(x, n, lambda w: div(F.sum(x * v).over(w), F.sum(v).over(w)), k, both)


def bb(x, n: int, mult: float, k: Keys = KEYS) -> Column:
    m, s = sma(x, n, k), stdev(x, n, k)
    return F.struct(m.alias("basis"), (m + mult * s).alias("upper"), (m - mult * s).alias("lower"))


def bbw(x, n: int, mult: float, k: Keys = KEYS) -> Column:
    return div(2 * mult * stdev(x, n, k), sma(x, n, k))


def cmo(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    d = change(x, 1, k)
    up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))

    def agg(w):
        u, v = F.sum(up).over(w), F.sum(down).over(w)
        return F.when(u + v == 0, F.lit(0.0)).otherwise(100 * (u - v) / (u + v))

    return v_frame(d, n, agg, k)


def mfi(x, n: int, k: Keys = KEYS) -> Column:
    x, v = col(x), F.col("volume")
    d = change(x, 1, k)
    pos, neg = F.when(d > 0, x * v).otherwise(0.0), F.when(d < 0, x * v).otherwise(0.0)

    def agg(w):
        p, q = F.sum(pos).over(w), F.sum(neg).over(w)
        return F.when(q == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + p / q))

    return v_frame(d, n, agg, k)


def ao(k: Keys = KEYS) -> Column:
    return sma(hl2(), 5, k) - sma(hl2(), 34, k)


def rci(x, n: int, k: Keys = KEYS) -> Column:
    """Rank correlation with time, in per cent; equal values share their mean rank."""
    x = col(x)

    def agg(w):
        values = F.collect_list(x).over(w)
        ranks = F.transform(values, lambda v: F.size(F.filter(values, lambda u: u < v)) + (F.size(F.filter(values, lambda u: u == v)) + 1) / 2.0)
        mid = (n + 1) / 2.0
        place = F.array(*[F.lit(i - mid) for i in range(1, n + 1)])
        cov = F.aggregate(F.zip_with(ranks, place, lambda r, p: (r - mid) * p), F.lit(0.0), lambda s, v: s + v)
        var = F.aggregate(F.transform(ranks, lambda r: (r - mid) * (r - mid)), F.lit(0.0), lambda s, v: s + v)
        scale = F.sqrt(var * F.lit(n * (n * n - 1) / 12.0))
        return F.when(scale == 0, F.lit(0.0)).otherwise(100 * cov / scale)

    return v_frame(x, n, agg, k)


def mode(x, n: int, k: Keys = KEYS) -> Column:
    """Most frequent of the last n valid values, the smallest of equals; it stands on rows without a value too."""
    x = col(x)

    def pick(w):
        values = F.sort_array(F.collect_list(x).over(w))
        best = F.aggregate(
            values, F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("v")),
            lambda s, v: F.when(F.size(F.filter(values, lambda u: u == v)) > s["n"], F.struct(F.size(F.filter(values, lambda u: u == v)).alias("n"), v.alias("v"))).otherwise(s),
        )
        return best["v"]

    here = v_frame(x, n, pick, k)
    return F.last(here, ignorenulls=True).over(k.upto())


# --- bar windows that skip na


def highest(x="high", n: int = 1, k: Keys = KEYS) -> Column:
    x = col(x)
    return b_frame(n, lambda w: F.max(x).over(w), k)


def lowest(x="low", n: int = 1, k: Keys = KEYS) -> Column:
    x = col(x)
    return b_frame(n, lambda w: F.min(x).over(w), k)


def highestbars(x="high", n: int = 1, k: Keys = KEYS) -> Column:
    """Distance to the highest bar of the frame, 0 or negative; the latest of equals."""
    x, i = col(x), k.index()
    return b_frame(n, lambda w: F.max_by(i, F.when(x.isNotNull(), F.struct(x, i))).over(w) - i, k)


def lowestbars(x="low", n: int = 1, k: Keys = KEYS) -> Column:
    x, i = col(x), k.index()
    return b_frame(n, lambda w: F.min_by(i, F.when(x.isNotNull(), F.struct(x, -i))).over(w) - i, k)


def percentile_nearest_rank(x, n: int, p: float, k: Keys = KEYS) -> Column:
    x = col(x)

    def agg(w):
        values = F.sort_array(F.collect_list(x).over(w))
        return F.when(F.size(values) > 0, F.get(values, F.greatest(F.ceil(F.lit(p) / 100 * F.size(values)), F.lit(1)).cast("int") - 1))

    return b_frame(n, agg, k)


# --- bar windows that na poisons


def stoch(x, high, low, n: int, k: Keys = KEYS) -> Column:
    x, h, lo = col(x), col(high), col(low)
    full = F.when(h.isNotNull() & lo.isNotNull(), F.lit(1))
    return n_frame(full, n, lambda w: 100 * div(x - F.min(lo).over(w), F.max(h).over(w) - F.min(lo).over(w)), k)


def wpr(n: int, k: Keys = KEYS) -> Column:
    h, lo = F.col("high"), F.col("low")
    full = F.when(h.isNotNull() & lo.isNotNull(), F.lit(1))
    return n_frame(full, n, lambda w: -100 * div(F.max(h).over(w) - F.col("close"), F.max(h).over(w) - F.min(lo).over(w)), k)


def percentrank(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    before = F.collect_list(F.struct(x.alias("v"))).over(k.last(n, 1))
    at_most = F.size(F.filter(before, lambda s: s["v"] <= x))
    return F.when(x.isNotNull() & (F.size(before) == n), 100.0 * at_most / n)


def percentile_linear_interpolation(x, n: int, p: float, k: Keys = KEYS) -> Column:
    x = col(x)
    rank = min(max(p / 100 * n - 0.5, 0), n - 1)
    lo = int(rank)

    def agg(w):
        values = F.sort_array(F.collect_list(x).over(w))
        a, b = F.get(values, F.lit(lo)), F.get(values, F.lit(min(lo + 1, n - 1)))
        return a + (b - a) * (rank - lo)

    return n_frame(x, n, agg, k)


def swma(x, k: Keys = KEYS) -> Column:
    x = col(x)
    return (k.lag(x, 3) + 2 * k.lag(x, 2) + 2 * k.lag(x, 1) + x) / 6


def _steps(ok: Column, n: int, k: Keys) -> Column:
    hit = F.coalesce(ok, F.lit(False)).cast("int")
    return (F.min(hit).over(k.last(n)) == 1) & (F.count(F.lit(1)).over(k.last(n + 1)) == n + 1)


def rising(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return _steps(x > k.lag(x), n, k)


def falling(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return _steps(x < k.lag(x), n, k)


def _pivot(x, left: int, right: int, sign: int, k: Keys) -> Column:
    x = col(x) * sign
    centre = k.lag(x, right)
    ok = F.count(x).over(k.last(left + right + 1)) == left + right + 1
    if left:
        ok = ok & (centre > F.max(x).over(k.last(left, right + 1)))
    if right:
        ok = ok & (centre > F.max(x).over(k.last(right)))
    return F.when(ok, centre * sign)


def pivothigh(x="high", left: int = 1, right: int = 1, k: Keys = KEYS) -> Column:
    return _pivot(x, left, right, 1, k)


def pivotlow(x="low", left: int = 1, right: int = 1, k: Keys = KEYS) -> Column:
    return _pivot(x, left, right, -1, k)


# --- lags


def change(x, n: int = 1, k: Keys = KEYS) -> Column:
    x = col(x)
    return x - k.lag(x, n)


mom = change


def roc(x, n: int, k: Keys = KEYS) -> Column:
    x = col(x)
    return 100 * div(x - k.lag(x, n), k.lag(x, n))


def crossover(a, b, k: Keys = KEYS) -> Column:
    a, b = col(a), col(b)
    return F.coalesce((k.lag(a) <= k.lag(b)) & (a > b), F.lit(False))


def crossunder(a, b, k: Keys = KEYS) -> Column:
    a, b = col(a), col(b)
    return F.coalesce((k.lag(a) >= k.lag(b)) & (a < b), F.lit(False))


def cross(a, b, k: Keys = KEYS) -> Column:
    return crossover(a, b, k) | crossunder(a, b, k)


def tr(handle_na: bool = False, k: Keys = KEYS) -> Column:
    h, lo, before = F.col("high"), F.col("low"), k.lag(F.col("close"))
    first = h - lo if handle_na else F.lit(None).cast("double")
    return F.when(before.isNull(), first).otherwise(F.greatest(h - lo, F.abs(h - before), F.abs(lo - before)))


# --- cumulative


def max_(x, k: Keys = KEYS) -> Column:
    return F.max(col(x)).over(k.upto())


def min_(x, k: Keys = KEYS) -> Column:
    return F.min(col(x)).over(k.upto())


def cum(x, k: Keys = KEYS) -> Column:
    return F.coalesce(F.sum(col(x)).over(k.upto()), F.lit(0.0))


def barssince(cond, k: Keys = KEYS) -> Column:
    i = k.index()
    return i - F.max(F.when(col(cond), i)).over(k.upto())


def valuewhen(cond, x, occurrence: int = 0, k: Keys = KEYS) -> Column:
    """The value at the n-th latest bar where the condition held, na values included."""
    cond, x = F.coalesce(col(cond), F.lit(False)), col(x)
    if occurrence == 0:
        return F.last(F.when(cond, F.struct(x.alias("v"))), ignorenulls=True).over(k.upto())["v"]
    # the hits of a symbol stand in a window of their own, where the n-th before is a lag
    hits = Window.partitionBy(*k.by, cond).orderBy(*k.order)
    there = F.when(cond, F.struct(F.lag(x, occurrence).over(hits).alias("v")))
    return F.last(there, ignorenulls=True).over(k.upto())["v"]


def fixnan(x, k: Keys = KEYS) -> Column:
    return F.last(col(x), ignorenulls=True).over(k.upto())


def obv(k: Keys = KEYS) -> Column:
    return cum(F.signum(change("close", 1, k)) * F.col("volume"), k)


def accdist(k: Keys = KEYS) -> Column:
    o, h, lo, c, v = _ohlcv()
    return cum(F.when(h == lo, F.lit(0.0)).otherwise(((c - lo) - (h - c)) / F.nullif(h - lo, F.lit(0.0)) * v), k)


def iii() -> Column:
    o, h, lo, c, v = _ohlcv()
    d = (h - lo) * v
    return F.when(d == 0, F.lit(0.0)).otherwise((2 * c - h - lo) / F.nullif(d, F.lit(0.0)))


def wvad() -> Column:
    o, h, lo, c, v = _ohlcv()
    return F.when(h == lo, F.lit(0.0)).otherwise((c - o) / F.nullif(h - lo, F.lit(0.0)) * v)


def wad(k: Keys = KEYS) -> Column:
    o, h, lo, c, v = _ohlcv()
    p = k.lag(c)
    gain = F.when(c > p, c - F.least(p, lo)).when(c < p, c - F.greatest(p, h)).otherwise(0.0)
    return cum(gain, k)


def _volume_index(ok: Column, k: Keys) -> Column:
    c, p = F.col("close"), k.lag(F.col("close"))
    return F.product(F.when(ok & (c != 0) & (p != 0), c / F.nullif(p, F.lit(0.0))).otherwise(1.0)).over(k.upto())


def nvi(k: Keys = KEYS) -> Column:
    return _volume_index(F.coalesce(F.col("volume") < k.lag(F.col("volume")), F.lit(False)), k)


def pvi(k: Keys = KEYS) -> Column:
    return _volume_index(F.coalesce(F.col("volume") > k.lag(F.col("volume")), F.lit(False)), k)


def pvt(k: Keys = KEYS) -> Column:
    p = k.lag(F.col("close"))
    return cum(div(F.col("close") - p, p) * F.col("volume"), k)


def up_and_down_volume() -> Column:
    o, h, lo, c, v = _ohlcv()
    up, down = F.when(c > o, v).otherwise(0.0), F.when(c < o, -v).otherwise(0.0)
    return F.struct(up.alias("up"), down.alias("down"), (up + down).alias("delta"))


def segment(reset, k: Keys = KEYS) -> Column:
    """The number of anchors so far."""
    return F.sum(F.coalesce(col(reset), F.lit(False)).cast("int")).over(k.upto())


def new_day(k: Keys = KEYS) -> Column:
    d = F.to_date("time")
    return F.coalesce(d != k.lag(d), F.lit(True))


def vwap(x, anchor=None, mult: float | None = None, k: Keys = KEYS) -> Column:
    """Volume-weighted mean since the anchor (a new UTC day if none), with bands if ``mult`` is given."""
    x, v = col(x), F.col("volume")
    seg = segment(new_day(k) if anchor is None else anchor, k)
    ok = x.isNotNull() & v.isNotNull()
    w = Window.partitionBy(*k.by, seg).orderBy(*k.order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(ok, v)).over(w)
    mean = div(F.sum(F.when(ok, x * v)).over(w), total)
    if mult is None:
        return mean
    s = F.sqrt(F.greatest(F.lit(0.0), div(F.sum(F.when(ok, x * x * v)).over(w), total) - mean * mean))
    return F.struct(mean.alias("vwap"), (mean + mult * s).alias("upper"), (mean - mult * s).alias("lower"))


def previous_segment(anchor, k: Keys = KEYS) -> dict[str, Column]:
    """Open, high, low, close of the segment before the current one, and the current segment's open so far."""
    seg = segment(anchor, k)
    w = Window.partitionBy(*k.by, seg).orderBy(*k.order).rowsBetween(Window.unboundedPreceding, 0)
    now = {
        "open": F.first("open").over(w), "high": F.max("high").over(w), "low": F.min("low").over(w), "close": F.last("close").over(w),
    }
    # at an anchor the row before it closes the segment before
    start = F.coalesce(col(anchor), F.lit(False)) & (seg >= 2)
    return {n: F.last(F.when(start, F.struct(k.lag(c).alias("v"))), ignorenulls=True).over(k.upto())["v"] for n, c in now.items()} | {"now_open": now["open"]}


def pivot_point_levels(kind: str, anchor, k: Keys = KEYS) -> Column:
    """[P, R1, S1, R2, S2, R3, S3, R4, S4, R5, S5] of the segment before; na where the kind has no such level."""
    b = previous_segment(anchor, k)
    o, h, lo, c, now = b["open"], b["high"], b["low"], b["close"], b["now_open"]
    r = h - lo
    na = F.lit(None).cast("double")
    if kind == "Traditional":
        p = (h + lo + c) / 3
        out = [p, 2 * p - lo, 2 * p - h, p + r, p - r, 2 * p + (h - 2 * lo), 2 * p - (2 * h - lo), 3 * p + (h - 3 * lo), 3 * p - (3 * h - lo), 4 * p + (h - 4 * lo), 4 * p - (4 * h - lo)]
    elif kind == "Fibonacci":
        p = (h + lo + c) / 3
        out = [p, *[q for f in (0.382, 0.618, 1.0) for q in (p + f * r, p - f * r)], na, na, na, na]
    elif kind == "Woodie":
        p = (h + lo + 2 * now) / 4
        r3, s3 = h + 2 * (p - lo), lo - 2 * (h - p)
        out = [p, 2 * p - lo, 2 * p - h, p + r, p - r, r3, s3, r3 + r, s3 - r, na, na]
    elif kind == "Classic":
        p = (h + lo + c) / 3
        out = [p, 2 * p - lo, 2 * p - h, p + r, p - r, p + 2 * r, p - 2 * r, p + 3 * r, p - 3 * r, na, na]
    elif kind == "DM":
        x = F.when(o == c, h + lo + 2 * c).when(c > o, 2 * h + lo + c).otherwise(2 * lo + h + c)
        out = [x / 4, x / 2 - lo, x / 2 - h, *[na] * 8]
    elif kind == "Camarilla":
        p = (h + lo + c) / 3
        out = [p, *[q for f in (12, 6, 4, 2) for q in (c + 1.1 * r / f, c - 1.1 * r / f)]]
        out += [na, na]
    else:
        raise ValueError(f"unknown kind of pivot levels: {kind}")
    return F.array(*[x.cast("double") for x in out])
