"""Array functions. Columns are immutable: functions that change an array give the changed array; reads of no element give na."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.na import col, div

_TYPES = {"float": "double", "int": "long", "bool": "boolean", "string": "string", "color": "string", "line": "long", "label": "long", "box": "long", "table": "long", "linefill": "long"}
_FILL = {"bool": False, "string": "", "color": "#00000000"}


def new(size=0, initial=None, kind: str = "float") -> Column:
    """An array of ``size`` equal elements of a kind: float, int, bool, string, color, or a drawing kind (ids)."""
    x = _FILL.get(kind) if initial is None else initial
    return F.array_repeat(col(x).cast(_TYPES[kind]) if not isinstance(x, str) else F.lit(x), F.greatest(col(size).cast("int"), F.lit(0)))


#: Arrays of one kind; colours are texts, drawings the numbers by which a log knows them.
new_float, new_int, new_bool, new_string, new_color = (partial(new, kind=k) for k in ("float", "int", "bool", "string", "color"))
new_line, new_label, new_box, new_table, new_linefill = (partial(new, kind=k) for k in ("line", "label", "box", "table", "linefill"))


def from_(*items) -> Column:
    return F.array(*[col(x) for x in items])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _known(a) -> Column:
    return F.array_compact(col(a).cast("array<double>"))


def _some(a: Column, x: Column) -> Column:
    return F.when(F.size(a) > 0, x)


def push(a, x) -> Column:
    return F.array_append(col(a), col(x))


def unshift(a, x) -> Column:
    return F.array_prepend(col(a), col(x))


def last(a) -> Column:
    return F.try_element_at(col(a), F.lit(-1))


def first(a) -> Column:
    return F.get(col(a), F.lit(0))


def pop(a) -> Column:
    """The array without its last element, which is ``last``."""
    a = col(a)
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a) -> Column:
    """The array without its first element, which is ``first``."""
    a = col(a)
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def get(a, i) -> Column:
    return F.get(col(a), col(i).cast("int"))


def set_(a, i, x) -> Column:
    a, i, x = col(a), col(i), col(x)
    return F.transform(a, lambda v, k: F.when(k == i, x).otherwise(v))


def size(a) -> Column:
    return F.size(col(a))


def clear(a) -> Column:
    return F.slice(col(a), 1, 0)


def insert(a, i, x) -> Column:
    a, i = col(a), col(i).cast("int")
    at = F.least(F.greatest(i, F.lit(0)), F.size(a))
    return F.concat(F.slice(a, 1, at), F.array(col(x)), F.slice(a, at + 1, F.size(a) - at))


def remove(a, i) -> Column:
    """The array without element i, which is ``get``."""
    a, i = col(a), col(i).cast("int")
    inside = (i >= 0) & (i < F.size(a))
    cut = F.concat(F.slice(a, 1, F.greatest(i, F.lit(0))), F.slice(a, F.greatest(i, F.lit(0)) + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))
    return F.when(inside, cut).otherwise(a)


def reverse(a) -> Column:
    return F.reverse(col(a))


def includes(a, x) -> Column:
    return F.coalesce(F.exists(col(a), lambda v: v == col(x)), F.lit(False))


def indexof(a, x) -> Column:
    return F.coalesce(F.array_position(col(a), col(x)), F.lit(0)) - 1


def lastindexof(a, x) -> Column:
    a = col(a)
    p = F.array_position(F.reverse(a), col(x))
    return F.when(p > 0, F.size(a) - p).otherwise(F.lit(-1)).cast("long")


def binary_search(a, x) -> Column:
    """Of an ascending array without equals."""
    return indexof(a, x)


def _below(a, x, inclusive: bool) -> Column:
    a, x = col(a), col(x)
    return F.size(F.filter(a, lambda v: v <= x if inclusive else v < x))


def binary_search_leftmost(a, x) -> Column:
    at = _below(a, x, False)
    return F.when(F.get(col(a), at) == col(x), at).otherwise(at - 1)


def binary_search_rightmost(a, x) -> Column:
    at = _below(a, x, True)
    return F.when((at > 0) & (F.get(col(a), F.greatest(at - 1, F.lit(0))) == col(x)), at - 1).otherwise(at)


def sum_(a) -> Column:
    v = _known(a)
    return _some(v, _sum(v))


def avg(a) -> Column:
    v = _known(a)
    return _some(v, _sum(v) / F.size(v))


def min_(a, nth: int = 0) -> Column:
    return F.get(F.sort_array(_known(a)), F.lit(nth))


def max_(a, nth: int = 0) -> Column:
    return F.get(F.sort_array(_known(a), False), F.lit(nth))


def copy(a) -> Column:
    return col(a)


def slice_(a, start=0, end=None) -> Column:
    a, s = col(a), col(start).cast("int")
    e = F.size(a) if end is None else col(end).cast("int")
    return F.slice(a, s + 1, F.greatest(e - s, F.lit(0)))


def concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def join(a, separator: str = ",") -> Column:
    return F.array_join(F.transform(col(a), lambda v: F.coalesce(v.cast("string"), F.lit("NaN"))), separator)


def fill(a, x, start=0, end=None) -> Column:
    a, x, s = col(a), col(x), col(start)
    e = F.size(a) if end is None else col(end)
    return F.transform(a, lambda v, k: F.when((k >= s) & (k < e), x).otherwise(v))


def range_(a) -> Column:
    return F.array_max(_known(a)) - F.array_min(_known(a))


def sort(a, order: str = "ascending") -> Column:
    """na last either way."""
    a = col(a)
    known = F.array_compact(a)
    gone = F.filter(a, lambda v: v.isNull())
    return F.concat(F.sort_array(known, order != "descending"), gone)


def median(a) -> Column:
    v = F.sort_array(_known(a))
    n = F.size(v)
    lo, hi = F.get(v, F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return _some(v, (lo + hi) / 2)


def mode(a) -> Column:
    """The most frequent value, the smallest of equals."""
    v = F.sort_array(_known(a))
    count = lambda x: F.size(F.filter(v, lambda u: u == x))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.array_distinct(v), start, lambda s, x: F.when(count(x) > s["n"], F.struct(count(x).alias("n"), x.alias("v"))).otherwise(s))["v"]


def variance(a, biased: bool = True) -> Column:
    v = _known(a)
    mean = _sum(v) / F.size(v)
    return _some(v, div(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), F.size(v) - (0 if biased else 1)))


def stdev(a, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def covariance(a, b, biased: bool = True) -> Column:
    """Over the pairs that both have."""
    pairs = F.filter(F.arrays_zip(col(a).cast("array<double>").alias("x"), col(b).cast("array<double>").alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    n = F.size(pairs)
    mean = lambda c: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p[c]) / n
    top = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - mean("x")) * (p["y"] - mean("y")))
    return F.when(n > 0, div(top, n - (0 if biased else 1)))


def sort_indices(a, order: str = "ascending") -> Column:
    a = col(a)
    sign = -1 if order == "descending" else 1
    keyed = F.array_sort(F.transform(a, lambda v, i: F.struct(v.isNull().alias("na"), (v * sign).alias("v"), i.alias("i"))))
    return F.transform(keyed, lambda s: s["i"])


def standardize(a) -> Column:
    m, s = avg(a), stdev(a)
    return F.transform(col(a).cast("array<double>"), lambda v: F.coalesce(div(v - m, s), F.when(v.isNotNull(), F.lit(0.0))))


def abs_(a) -> Column:
    return F.transform(col(a), lambda v: F.abs(v))


def percentile_nearest_rank(a, p: float) -> Column:
    v = F.sort_array(_known(a))
    return F.get(v, F.greatest(F.ceil(F.lit(p) / 100 * F.size(v)).cast("int") - 1, F.lit(0)))


def percentile_linear_interpolation(a, p: float) -> Column:
    v = F.sort_array(_known(a))
    at = F.lit(p) / 100 * (F.size(v) - 1)
    lo = F.floor(at).cast("int")
    x, y = F.get(v, F.greatest(lo, F.lit(0))), F.get(v, F.greatest(F.least(lo + 1, F.size(v) - 1), F.lit(0)))
    return _some(v, x + (y - x) * (at - lo))


def percentrank(a, i) -> Column:
    a = col(a)
    x = get(a, i)
    return F.when(x.isNotNull() & (F.size(a) > 1), 100.0 * F.size(F.filter(a, lambda v: v < x)) / (F.size(a) - 1))


def _truthy(v: Column) -> Column:
    return F.coalesce(v.cast("boolean"), F.lit(False))


def every(a) -> Column:
    return F.forall(col(a), _truthy)


def some(a) -> Column:
    return F.exists(col(a), _truthy)


FUNCTIONS: dict[str, Callable] = {n.rstrip("_"): f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}
