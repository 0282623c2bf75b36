"""Map functions. Keys keep the order of insertion; functions that change a map give the changed map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.na import col


def new(key: str = "string", value: str = "double") -> Column:
    return F.create_map().cast(f"map<{key},{value}>")


def put(m, k, v) -> Column:
    """A key that is there keeps its place."""
    m, k, v = col(m), col(k), col(v)
    one = F.create_map(k, v)
    return F.when(F.map_contains_key(m, k), F.transform_values(m, lambda x, old: F.when(x == k, v).otherwise(old))).otherwise(F.map_concat(F.map_filter(m, lambda x, _: x != k), one))


def get(m, k) -> Column:
    return F.try_element_at(col(m), col(k))


def contains(m, k) -> Column:
    return F.map_contains_key(col(m), col(k))


def remove(m, k) -> Column:
    return F.map_filter(col(m), lambda x, _: x != col(k))


def keys(m) -> Column:
    return F.map_keys(col(m))


def values(m) -> Column:
    return F.map_values(col(m))


def size(m) -> Column:
    return F.size(col(m))


def clear(m) -> Column:
    return F.map_filter(col(m), lambda k, v: F.lit(False))


def copy(m) -> Column:
    return col(m)


def put_all(m, other) -> Column:
    """Values of ``other`` win."""
    m, o = col(m), col(other)
    kept = F.transform_values(m, lambda k, v: F.when(F.map_contains_key(o, k), F.try_element_at(o, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(o, lambda k, _: ~F.map_contains_key(m, k)))
