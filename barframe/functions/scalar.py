"""Scalar functions: mathematics, strings, colours, dates."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from barframe.na import clean, col, div

PI, E, PHI, RPHI = 3.141592653589793, 2.718281828459045, 1.618033988749895, 0.618033988749895


# --- mathematics


def _all(xs: tuple, f) -> Column:
    """na if any argument is na."""
    xs = [col(x).cast("double") for x in xs]
    some = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
    return F.when(some, f(xs))


def max_of(*xs) -> Column:
    return _all(xs, lambda v: F.greatest(*v) if len(v) > 1 else v[0])


def min_of(*xs) -> Column:
    return _all(xs, lambda v: F.least(*v) if len(v) > 1 else v[0])


def avg_of(*xs) -> Column:
    return _all(xs, lambda v: reduce(lambda a, b: a + b, v) / len(v))


def round_half_away(x, precision: int = 0) -> Column:
    """Ties go away from zero, on the binary value scaled by a power of ten."""
    x, p = col(x).cast("double"), float(10**precision)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5).cast("double") / p


def round_to_mintick(x) -> Column:
    return round_half_away(x, 2)


def power(b, e) -> Column:
    return clean(F.pow(col(b).cast("double"), col(e).cast("double")))


def sqrt(x) -> Column:
    x = col(x).cast("double")
    return F.when(x >= 0, F.sqrt(x))


def asin(x) -> Column:
    return clean(F.asin(col(x)))


def acos(x) -> Column:
    return clean(F.acos(col(x)))


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


def sign(x) -> Column:
    return F.signum(col(x))


def factorial(n: Column) -> Column:
    """n! as double for truncated n; na below 0."""
    n = F.floor(col(n).cast("double")).cast("int")
    return F.when(n >= 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1.0), lambda s, i: s * i))


def gcd(a, b) -> Column:
    """Euclid's divisor of the truncated absolute values, na if both are 0."""
    a, b = F.abs(col(a).cast("double").cast("long")), F.abs(col(b).cast("double").cast("long"))
    start = F.struct(a.alias("x"), b.alias("y"))
    # the remainders of 64-bit numbers are used up in fewer than 93 steps
    step = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.coalesce(F.try_mod(s["x"], s["y"]), F.lit(0).cast("long")).alias("y"))))
    return step["x"]


@pandas_udf(T.DoubleType())
def _uniform(seed: pd.Series) -> pd.Series:
    import numpy as np

    with np.errstate(over="ignore"):
        a = (seed.fillna(0).astype("int64").to_numpy() & 0xFFFFFFFF).astype(np.uint32) + np.uint32(0x6D2B79F5)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return pd.Series((t ^ (t >> np.uint32(14))) / 4294967296.0)


def random(seed, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform on [low, high) as a pure function of the seed."""
    return low + _uniform(col(seed).cast("long")) * (high - low)


# --- strings


def contains(s, sub) -> Column:
    return F.coalesce(F.contains(col(s), col(sub)), F.lit(False))


def str_pos(s, sub: str) -> Column:
    p = F.instr(col(s), sub)
    return F.when(p > 0, p - 1)


def str_replace(s, target: str, replacement: str, occurrence: int = 0) -> Column:
    """Replaces one occurrence, counted from 0."""
    s = col(s)
    parts = F.split(s, re.escape(target).replace("\\ ", " "), -1)
    n = occurrence + 1
    head, tail = F.array_join(F.slice(parts, 1, n), target), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), target)
    return F.when(F.size(parts) > n, F.concat(head, F.lit(replacement), tail)).otherwise(s)


def str_substring(s, begin, end=None) -> Column:
    s = col(s)
    b = F.greatest(col(begin).cast("int"), F.lit(0))
    e = F.length(s) if end is None else F.greatest(col(end).cast("int"), F.lit(0))
    return F.substring(s, b + 1, F.greatest(e - b, F.lit(0)))


def str_trim(s) -> Column:
    return F.regexp_replace(F.coalesce(col(s), F.lit("")), r"^[\s\x00-\x20]+|[\s\x00-\x20]+$", "")


def str_repeat(s, n: int, separator: str = "") -> Column:
    return F.lit("") if n <= 0 else F.array_join(F.array_repeat(col(s), n), separator)


def str_match(s, regex: str) -> Column:
    return F.coalesce(F.regexp_extract(col(s), regex, 0), F.lit(""))


def str_split(s, separator: str) -> Column:
    return F.split(col(s), "" if separator == "" else "\\Q" + separator + "\\E", -1)


def str_tonumber(s) -> Column:
    s = F.trim(col(s))
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))


@pandas_udf(T.StringType())
def _decimal_format(x: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else format_number(v, p) for v, p in zip(x, pattern)])


def format_number(v: float | None, pattern: str) -> str:
    """A decimal pattern: ``#`` optional and ``0`` mandatory digits, grouping commas, per cent, literal ends."""
    if v is None or v != v:
        return "NaN"
    m = re.search(r"[#0,]*\.?[#0]*", pattern[re.search(r"[#0.]", pattern).start():]) if re.search(r"[#0.]", pattern) else None
    if m is None:
        return pattern
    at = re.search(r"[#0.]", pattern).start()
    head, body, tail = pattern[:at], m.group(), pattern[at + len(m.group()):]
    whole, _, part = body.partition(".")
    v = v * 100 if "%" in head + tail else v
    places, least = len(part), part.count("0")
    scaled = int(abs(v) * 10**places + 0.5)
    i, f = str(scaled // 10**places), str(scaled % 10**places).zfill(places) if places else ""
    while len(f) > least and f.endswith("0"):
        f = f[:-1]
    i = i.zfill(whole.count("0")) if whole.count("0") else ("" if i == "0" and f else i)
    if "," in whole:
        size = len(whole) - whole.rindex(",") - 1
        i = "".join(c + ("," if k and k % size == 0 else "") for k, c in [(len(i) - 1 - n, c) for n, c in enumerate(i)])
    return ("-" if v < 0 and scaled else "") + head + i + ("." + f if f else "") + tail


def str_tostring(x, pattern: str | None = None) -> Column:
    """Plain, by decimal pattern, or by a named one: integer, mintick, percent, volume."""
    x = col(x)
    if pattern is None:
        return F.coalesce(x.cast("string"), F.lit("NaN"))
    if pattern == "volume":
        a = F.abs(x)
        scale = lambda d, unit: F.concat(_decimal_format((x / d).cast("double"), F.lit("#.###")), F.lit(unit))
        return F.when(x.isNull(), "NaN").when(a >= 1e12, scale(1e12, "T")).when(a >= 1e9, scale(1e9, "B")).when(a >= 1e6, scale(1e6, "M")).when(a >= 1e3, scale(1e3, "K")).otherwise(_decimal_format(x.cast("double"), F.lit("0")))
    named = {"integer": "#", "mintick": "0.00", "percent": "0.00%"}
    if pattern == "percent":
        return F.concat(_decimal_format(x.cast("double"), F.lit("0.00")), F.lit("%"))
    return _decimal_format(x.cast("double"), F.lit(named.get(pattern, pattern)))


def str_format(fmt: str, *args) -> Column:
    """``{n}`` and ``{n,number,pattern}`` placeholders; doubled quotes are a quote, quoted text is literal."""
    out, at = [], 0
    for m in re.finditer(r"''|'([^']*)'|\{(\d+)(?:\s*,\s*number(?:\s*,\s*([^}]*))?)?\}", fmt):
        out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        if m.group(2) is not None:
            n = int(m.group(2))
            out.append(F.lit(m.group()) if n >= len(args) else str_tostring(args[n], m.group(3) or ("#,##0.###" if "number" in m.group() else None)))
        else:
            out.append(F.lit("'" if m.group() == "''" else m.group(1)))
    return F.concat(*out, F.lit(fmt[at:]))


def str_format_time(time, pattern: str = "yyyy-MM-dd'T'HH:mm:ssZ", tz: str = "UTC") -> Column:
    """A bar time (UTC) on the wall clock of ``tz``."""
    return F.date_format(F.from_utc_timestamp(col(time).cast("timestamp"), tz), pattern.replace("Z", "'+0000'") if tz == "UTC" else pattern)


# --- colours, as #RRGGBBAA


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(F.greatest(F.least(round_half_away(x), F.lit(255.0)), F.lit(0.0)).cast("long")), 2, "0")


def _part(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 2), 16, 10).cast("double")


def color_rgb(r, g, b, transp=0) -> Column:
    return F.concat(F.lit("#"), _hex(col(r)), _hex(col(g)), _hex(col(b)), _hex(255.0 * (100 - col(transp)) / 100))


def color_new(c, transp=None) -> Column:
    c = col(c)
    return c if transp is None else F.concat(F.substring(c, 1, 7), _hex(255.0 * (100 - col(transp)) / 100))


def color_r(c) -> Column:
    return _part(col(c), 2)


def color_g(c) -> Column:
    return _part(col(c), 4)


def color_b(c) -> Column:
    return _part(col(c), 6)


def color_t(c) -> Column:
    c = col(c)
    return F.when(F.length(c) >= 9, round_half_away((1 - _part(c, 8) / 255) * 100)).otherwise(F.lit(0.0))


def color_from_gradient(x, low, high, low_color, high_color) -> Column:
    x, low, high, a, b = col(x), col(low), col(high), col(low_color), col(high_color)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(div(x - low, high - low), F.lit(1.0))))
    mix = lambda f: f(a) + (f(b) - f(a)) * t
    return F.when(x.isNotNull(), color_rgb(mix(color_r), mix(color_g), mix(color_b), mix(color_t)))


# The named colours.
COLORS = {
    "aqua": "#00BCD4FF", "black": "#363A45FF", "blue": "#2962FFFF", "fuchsia": "#E040FBFF", "gray": "#787B86FF", "green": "#4CAF50FF", "lime": "#00E676FF", "maroon": "#880E4FFF",
    "navy": "#311B92FF", "olive": "#808000FF", "orange": "#FF9800FF", "purple": "#9C27B0FF", "red": "#F23645FF", "silver": "#B2B5BEFF", "teal": "#089981FF", "white": "#FFFFFFFF", "yellow": "#FDD835FF",
}


# --- dates, UTC


def date_parts(time) -> dict[str, Column]:
    """Sunday is day 1; the week of the year counts sevens of days from the first."""
    t = col(time)
    return {
        "year": F.year(t), "month": F.month(t), "dayofmonth": F.dayofmonth(t), "dayofweek": F.dayofweek(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t),
        "weekofyear": F.ceil(F.dayofyear(t) / 7.0).cast("int"),
    }


def timestamp_of(text) -> Column:
    """A time written as date, or date and time, UTC; na where it cannot be read."""
    t = F.trim(col(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).cast("timestamp_ntz")


def timestamp(year, month, day, hour=0, minute=0, second=0, tz: str = "UTC") -> Column:
    return F.try_make_timestamp(*[col(x).cast("int") for x in (year, month, day, hour, minute)], col(second).cast("decimal(8,6)"), F.lit(tz))
