"""Exact top-k search by inner product with a vector-approximation file.

Vectors are integer: floor(256 x) of every component as double. ``approximation_file`` writes, once, every vector as one cell
number per component: 2^bits equal steps between the least and the largest value of that component over all vectors. A scan of these
cells (a byte a component; no exact vector is read) bounds each query's scores from above and below; a task keeps the
rows whose upper bound reaches its k-th lower bound, and the k-th lower bound over all tasks leaves few rows of each query.
Their exact vectors are then read in the order of the bound: first the k best, then those whose upper bound still
reaches the k-th exact score. What is left cannot be among the k. Queries are taken in blocks of a bounded size.

Null vectors and vectors with a null or non-finite component take no part; neither do rows without an id. A component whose 256-fold
a double cannot hold counts as non-finite. Vectors of another length than the query's have no inner product with it. Ties go to
the smaller id. Repeated ids are repeated rows; a repeated query id is asked once, with any of its rows. A score
beyond a long counts as the long nearest to it. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import cut, drop, release

QUERY_BLOCK = 4096
BITS = 8
#: Rows and queries whose bounds are in memory at once.
CELL_ROWS, CELL_QUERIES = 2048, 512
_LONG = (1 << 63) - 1


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(ok)
    return rows.select("id", F.transform("v", _floor).alias("v"))


def _floor(x):
    """floor(256 x) as a double, also beyond a long."""
    y = x * 256
    return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of a query with some rows."""
    top = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * max(len(q), 1)
    if top < 2.0**53:
        return (x @ q).astype(np.int64)  # every partial sum is an integer that a double holds
    exact = [sum(int(a) * int(b) for a, b in zip(q, s)) for s in x]
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in exact], np.int64)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of each vector length of a batch."""
    vectors = batch.column(column)
    sizes = np.asarray(vectors.value_lengths().to_pylist(), np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def ranges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and largest value of each component, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, i, lo, hi) for d, _, x in _by_length(batch, "v") for i, (lo, hi) in enumerate(zip(x.min(0).tolist(), x.max(0).tolist()))]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["d", "i", "lo", "hi"])

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.mapInArrow(run, "d long, i long, lo double, hi double").groupBy("d", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        lo, hi = out.setdefault(r["d"], (np.zeros(r["d"]), np.zeros(r["d"])))
        lo[r["i"]], hi[r["i"]] = r["lo"], r["hi"]
    return out


def steps(lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    return np.maximum(hi / (1 << bits) - lo / (1 << bits), 1e-9)


def cells(x: np.ndarray, lo: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    return np.clip(np.floor((x - lo) / step), 0, (1 << bits) - 1).astype(np.uint8)


def bounds(q: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds (query by row) of the inner products of the vectors in the cells."""
    with np.errstate(all="ignore"):
        low = (q * step) @ cell.T.astype(np.float64) + (q @ lo)[:, None]
        slack = 1e-9 * (1 + np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)))
        up = low + (np.maximum(q, 0) @ step + slack)[:, None]
        low += (np.minimum(q, 0) @ step - slack)[:, None]
    return np.nan_to_num(up, nan=np.inf, posinf=np.inf), np.nan_to_num(low, nan=-np.inf, neginf=-np.inf)


class Scan:
    """The rows of one task that can be among the k best of a query, by their cells alone."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.floors = np.full((len(ids), k), -np.inf)  # the k largest lower bounds
        self.held: list[tuple] = []

    def add(self, ids: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> None:
        for s in range(0, len(ids), CELL_ROWS):
            for a in range(0, len(self.ids), CELL_QUERIES):
                self._add(slice(a, a + CELL_QUERIES), ids[s : s + CELL_ROWS], cell[s : s + CELL_ROWS], lo, hi, step)

    def _add(self, part: slice, ids: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> None:
        up, low = bounds(self.q[part], cell, lo, hi, step)
        own = ids[None, :] == self.ids[part][:, None]
        up[own], low[own] = -np.inf, -np.inf
        top = np.partition(low, -self.k, axis=1)[:, -self.k :] if low.shape[1] > self.k else low
        floors = np.sort(np.concatenate([self.floors[part], top], axis=1), axis=1)[:, -self.k :]
        self.floors[part] = floors
        query, row = np.nonzero((up >= floors[:, :1]) & ~own)
        self.held.append((query + part.start, ids[row], up[query, row], low[query, row]))
        if sum(len(h[0]) for h in self.held) > 1 << 20:
            self.held = [self._left()]

    def _left(self) -> tuple:
        query, ids, up, low = (np.concatenate([h[j] for h in self.held]) for j in range(4))
        ok = up >= self.floors[query, 0]
        return query[ok], ids[ok], up[ok], low[ok]

    def rows(self) -> tuple:
        """query_id, vec_id, upper and lower bound."""
        query, ids, up, low = self._left() if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return self.ids[query], ids, up, low


def approximation_file(rows: DataFrame, limits: dict, bits: int = BITS) -> DataFrame:
    """id, d and the cells of every vector, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch, "v"):
                lo, hi = limits[d]
                code = cells(x, lo, steps(lo, hi, bits), bits)
                raw = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), d)), raw], names=["id", "d", "cells"])
        release()

    return cut(rows.mapInArrow(run, "id long, d long, cells binary"))


def _exact(chosen: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id, score of chosen pairs, from the exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.asarray(batch.column("query_id").to_pylist(), np.int64)
            asked = batch.column("q")
            for _, at, x in _by_length(batch, "v"):
                out = np.zeros(len(at), np.int64)
                for i in np.unique(q[at]):
                    one = np.flatnonzero(q[at] == i)
                    out[one] = scores(asked[int(at[one[0]])].values.to_numpy(zero_copy_only=False), x[one])
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), batch.column("vec_id").take(pa.array(at)), pa.array(out)], names=["query_id", "vec_id", "score"])

    both = chosen.select("query_id", "vec_id").join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return cut(both.where(F.size("v") == F.size("q")).mapInArrow(run, "query_id long, vec_id long, score long"))


def _kth(found: DataFrame, column: str, k: int) -> DataFrame:
    """query_id, floor: the k-th largest value of each query; queries with fewer have no row."""
    w = Window.partitionBy("query_id").orderBy(F.desc(column))
    return found.withColumn("at", F.row_number().over(w)).where(F.col("at") == k).select("query_id", F.col(column).cast("double").alias("floor"))


def candidates(file: DataFrame, asked: DataFrame, limits: dict, k: int, bits: int = BITS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, up: the pairs that the cells leave."""
    spark = asked.sparkSession
    blocks = max(1, -(-asked.count() // query_block))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        groups: dict[int, list] = {}
        for r in part.collect():
            groups.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        shared = spark.sparkContext.broadcast({d: (np.array([i for i, _ in g], np.int64), np.array([v for _, v in g], np.float64).reshape(len(g), d)) for d, g in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scans = {d: Scan(ids, q, k) for d, (ids, q) in shared.value.items()}
            for batch in batches:
                ids, sizes = np.asarray(batch.column("id").to_pylist(), np.int64), np.asarray(batch.column("d").to_pylist(), np.int64)
                for d in set(sizes.tolist()) & set(scans):
                    at = np.flatnonzero(sizes == d)
                    cell = np.frombuffer(b"".join(batch.column("cells").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), d)
                    lo, hi = limits[d]
                    scans[d].add(ids[at], cell, lo, hi, steps(lo, hi, bits))
            for s in scans.values():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in s.rows()], names=["query_id", "vec_id", "up", "low"])
            release()

        found = file.mapInArrow(run, "query_id long, vec_id long, up double, low double")
        out = found if out is None else out.unionAll(found)
    out = cut(out)
    left = out.join(_kth(out, "low", k), "query_id", "left").where(F.col("floor").isNull() | (F.col("up") >= F.col("floor")))
    left = cut(left.groupBy("query_id", "vec_id").agg(F.max("up").alias("up")))
    drop(out)
    return left


def top_k(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int, bits: int = BITS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every query, the query's own row left out."""
    rows = _usable(vectors, id_col, vec_col)
    asked = cut(_usable(queries, id_col, vec_col).dropDuplicates(["id"]))
    limits = ranges(rows)
    file = approximation_file(rows, limits, bits)
    pairs = candidates(file, asked, limits, k, bits, query_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("up"), "vec_id")
    ordered = cut(pairs.withColumn("at", F.row_number().over(w)))
    first = _exact(ordered.where(F.col("at") <= k), rows, asked)
    rest = ordered.where(F.col("at") > k).join(_kth(first, "score", k), "query_id", "left").where(F.col("floor").isNull() | (F.col("up") >= F.col("floor")))
    found = first.unionAll(_exact(rest, rows, asked))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
