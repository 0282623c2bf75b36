"""Timeframes, buckets and sessions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barframe.na import col
from barframe.operators.frames import KEYS, Keys

# Seconds of a unit; a month is its mean length.
SECONDS = {"T": 0, "S": 1, "": 60, "D": 86_400, "W": 604_800, "M": 2_628_003}


@dataclass(frozen=True)
class Timeframe:
    multiplier: int
    unit: str

    @property
    def seconds(self) -> int:
        return self.multiplier * SECONDS[self.unit]


def parse(tf: str) -> Timeframe:
    """``"60"`` is minutes; S, D, W and M follow a count or stand alone."""
    m = re.fullmatch(r"(\d*)([TSDWM]?)", tf.strip())
    if not m or not (m.group(1) or m.group(2)) or m.group(1) == "0":
        raise ValueError(f"not a timeframe: {tf!r}")
    return Timeframe(int(m.group(1) or 1), m.group(2))


def in_seconds(tf: str) -> int:
    return parse(tf).seconds


def from_seconds(s: int) -> str:
    """The shortest timeframe of at least ``s`` seconds in the largest unit that divides it."""
    for unit in ("W", "D", ""):
        if s % SECONDS[unit] == 0 and s >= SECONDS[unit]:
            n = s // SECONDS[unit]
            return f"{n}{unit}" if unit == "" or n > 1 else f"1{unit}"
    return f"{s}S"


def flags(tf: str) -> dict[str, bool | int | str]:
    t = parse(tf)
    return {
        "period": tf, "multiplier": t.multiplier, "isseconds": t.unit == "S", "isminutes": t.unit == "", "isintraday": t.unit in ("", "S"), "isdaily": t.unit == "D",
        "isweekly": t.unit == "W", "ismonthly": t.unit == "M", "isdwm": t.unit in ("D", "W", "M"), "isticks": t.unit == "T",
    }


def bucket(time, tf: str) -> Column:
    """The number of the period that holds a time, UTC; weeks start on Monday."""
    t, p = col(time).cast("timestamp"), parse(tf)
    if p.unit == "M":
        return F.floor((F.year(t) * 12 + F.month(t) - 1) / p.multiplier).cast("long")
    day = F.floor(F.unix_seconds(t) / 86_400)
    if p.unit == "W":
        return F.floor((day + 3) / (7 * p.multiplier)).cast("long")
    if p.unit == "D":
        return F.floor(day / p.multiplier).cast("long")
    return F.floor(F.unix_seconds(t) / p.seconds).cast("long")


def change(tf: str, k: Keys = KEYS) -> Column:
    """Whether a bar starts a new period; the first bar does."""
    b = bucket("time", tf)
    return F.coalesce(b != k.lag(b), F.lit(True))


def time_close(tf: str) -> Column:
    return F.col("time") + F.expr(f"INTERVAL {parse(tf).seconds} SECONDS")


def in_session(time, session: str, tz: str = "UTC") -> Column:
    """``HHMM-HHMM[:days]``, Sunday 1; over midnight if it ends before it starts; an unreadable session is always on."""
    m = re.fullmatch(r"(\d{2})(\d{2})-(\d{2})(\d{2})(?::([1-7]+))?", session.strip())
    if not m:
        return F.lit(True)
    a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    t = F.from_utc_timestamp(col(time).cast("timestamp"), tz)
    minute = F.hour(t) * 60 + F.minute(t)
    if a == b:
        inside = F.lit(True)
    else:
        inside = (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)
    return inside & F.dayofweek(t).isin([int(d) for d in m[5]]) if m[5] else inside


def session_time(session: str, tz: str = "UTC") -> Column:
    """The bar's time inside the session, else na."""
    return F.when(in_session("time", session, tz), F.col("time"))


def session_flags(k: Keys = KEYS) -> dict[str, Column]:
    d = F.to_date("time")
    return {"isfirstbar": F.coalesce(d != k.lag(d), F.lit(True)), "islastbar": F.coalesce(d != F.lead(d).over(k.bars()), F.lit(True))}


def last_bar(k: Keys = KEYS) -> dict[str, Column]:
    """Of the symbol's last bar, at every bar: its index and its time; and the day of the bar itself."""
    whole = k.bars().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {"last_bar_index": F.count(F.lit(1)).over(whole) - 1, "last_bar_time": F.max("time").over(whole), "time_tradingday": F.date_trunc("day", F.col("time")).cast("timestamp_ntz")}


def chart_point(time=None, index=None, price=None) -> Column:
    """A point of the chart; what is not given is na."""
    part = lambda x, kind: F.lit(None).cast(kind) if x is None else col(x).cast(kind)
    return F.struct(part(time, "timestamp_ntz").alias("time"), part(index, "long").alias("index"), part(price, "double").alias("price"))


def bar_state(k: Keys = KEYS) -> dict[str, Column]:
    first, last = k.lag(F.col("time")).isNull(), F.lead("time").over(k.bars()).isNull()
    return {"isfirst": first, "islast": last, "ishistory": F.lit(True), "isrealtime": F.lit(False), "isnew": F.lit(True), "isconfirmed": F.lit(True), "islastconfirmedhistory": last}
