"""Benchmark decontamination by suffix arrays of the training text.

Every task builds the suffix array of each shard of its documents, by prefix doubling, over all suffixes that begin with a word of the
benchmark (no match could begin elsewhere). Every suffix of the benchmark is then binary-searched in it: its neighbours there give its longest
verbatim match and where that lies, and the range that shares its first ``window`` words gives all places of the window. No document
is shuffled. The benchmark is read in blocks of a bounded size; each block is one broadcast.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. A window is ``window`` consecutive words of
an item; a shorter item is one window, an item without words none. Null and empty texts have no words; very long texts are read whole.
Items that share an id count as one item; an item without an id marks words but is not listed. Repeated documents are judged one by one.
Of equally long matches the first of the smallest doc_id is told. Empty tables give empty results, an empty benchmark no hits. Columns named like a result
are replaced by it in ``matches`` and kept in ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, cut, unwrapped, wrapped

WINDOW = 10
#: Benchmark text of one broadcast, and document text of one suffix array, in bytes.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("longest_match", T.LongType()),
]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The places with a known word (above 0), sorted by the words from there on, to ``depth`` words at least; a 0 ends a suffix."""
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    rank = ids.astype(np.uint64)
    reach = 1
    while True:
        far = np.zeros(len(at), np.uint64)
        inner = at + reach < len(rank)
        far[inner] = rank[at[inner] + reach]
        key = (rank[at] << np.uint64(32)) | far
        order = np.argsort(key)
        step = np.concatenate([[1], (np.diff(key[order]) > 0).astype(np.uint64)])
        rank[at[order]] = np.cumsum(step)
        reach *= 2
        if reach >= depth or step.all():
            return at[order]


class TestSuffixes:
    """The suffixes of one benchmark block, the window that each begins with, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window, self.vocab = window, {}
        self.names: list[str | None] = []
        self.item: list[int] = []  # of each suffix: its item, its place in it, its window (-1: none) and that window's length
        self.offset: list[int] = []
        self.key: list[int] = []
        size: list[int] = []
        by_name: dict[str, int] = {}
        keys: dict[tuple, int] = {}
        flat: list[int] = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if not ids:
                continue
            item = by_name.setdefault(name, len(self.names)) if name is not None else len(self.names)
            if item == len(self.names):
                self.names.append(name)
            m = min(window, len(ids))
            for o in range(len(ids)):
                self.item.append(item)
                self.offset.append(o)
                size.append(len(ids) - o)
                self.key.append(keys.setdefault(tuple(ids[o : o + m]), len(keys)) if o + m <= len(ids) else -1)
            flat += [*ids, 0]
        self.flat = np.array(flat, np.int64)
        self.at = np.flatnonzero(self.flat)
        self.size, self.deepest = np.array(size, np.int64), max(size, default=0)
        owned = np.array([(k, i) for k, i in zip(self.key, self.item) if k >= 0], np.int64).reshape(-1, 2)
        self.owners = np.unique(owned, axis=0)  # (window, item)
        first = {k: i for i, k in reversed(list(enumerate(self.key))) if k >= 0}
        self.windows = np.array([first[k] for k in range(len(keys))], np.int64)  # a suffix that begins with each window
        self.lengths = np.minimum(self.size[self.windows], window) if len(keys) else np.zeros(0, np.int64)
        self.order: np.ndarray | None = None

    def _common(self, ids: np.ndarray, places: np.ndarray, suffixes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words the training suffixes at ``places`` share with test suffixes, up to ``most``."""
        out = np.zeros(len(places), np.int64)
        on = np.arange(len(places))
        k = 0
        while len(on):
            left, right = places[on] + k, self.at[suffixes[on]] + k
            ok = (k < most[on]) & (left < len(ids))
            ok[ok] = ids[left[ok]] == self.flat[right[ok]]
            on = on[ok]
            k += 1
            out[on] = k
        return out

    def _bound(self, ids: np.ndarray, array: np.ndarray, suffixes: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
        """Where the first ``most`` words of each test suffix begin (or end) in the suffix array."""
        lo, hi = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(array))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            open_ = lo < hi
            place = array[np.minimum(mid, len(array) - 1)]
            same = self._common(ids, place, suffixes, np.where(open_, most, 0))
            whole = same >= most
            left = np.where(place + same < len(ids), ids[np.minimum(place + same, len(ids) - 1)], 0)
            right = self.flat[np.minimum(self.at[suffixes] + same, len(self.flat) - 1)]
            below = np.where(whole, upper, left < right)
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo

    def longest(self, ids: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix, the length of its longest match and a place of it (-1 without one)."""
        every = np.arange(len(self.at))
        if not len(array) or not len(every):
            return np.zeros(len(every), np.int64), np.full(len(every), -1)
        low = self._bound(ids, array, every, self.size, False)
        best, place = np.zeros(len(every), np.int64), np.full(len(every), -1)
        for near in (low - 1, low):
            there = (near >= 0) & (near < len(array))
            at = array[np.clip(near, 0, len(array) - 1)]
            n = self._common(ids, at, every, np.where(there, self.size, 0))
            place, best = np.where(n > best, at, place), np.maximum(best, n)
        return best, place

    def depth_of(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The longest match of each training suffix with any test suffix."""
        if self.order is None:
            suffixes = np.cumsum(self.flat > 0) - 1
            self.order = suffixes[suffix_array(self.flat, self.deepest)]
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(self.order))
        none = np.iinfo(np.int64).max
        while (lo < hi).any():
            mid, open_ = (lo + hi) // 2, lo < hi
            test = self.order[np.minimum(mid, len(self.order) - 1)]
            same = self._common(ids, places, test, np.where(open_, self.size[test], 0))
            left = ids[np.minimum(places + same, len(ids) - 1)]
            right = np.where(same < self.size[test], self.flat[np.minimum(self.at[test] + same, len(self.flat) - 1)], 0)
            below = right < np.where(left == 0, none, left)
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        best = np.zeros(len(places), np.int64)
        for near in (lo - 1, lo):
            there = (near >= 0) & (near < len(self.order))
            test = self.order[np.clip(near, 0, len(self.order) - 1)]
            best = np.maximum(best, self._common(ids, places, test, np.where(there, self.size[test], 0)))
        return best

    def occurrences(self, ids: np.ndarray, array: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window."""
        found = np.flatnonzero(best[self.windows] >= self.lengths) if len(self.windows) else np.zeros(0, np.int64)
        if not len(found):
            return found, found
        suffixes, most = self.windows[found], self.lengths[found]
        lo, hi = self._bound(ids, array, suffixes, most, False), self._bound(ids, array, suffixes, most, True)
        count = hi - lo
        first = np.repeat(np.cumsum(count) - count, count)
        return array[np.repeat(lo, count) + np.arange(count.sum()) - first], np.repeat(found, count)


def _layout(block: TestSuffixes, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The word ids of a shard (0: not in the benchmark, and between texts), where each text begins, and its words' count."""
    get, parts, sizes = block.vocab.get, [], []
    zero = np.zeros(1, np.int64)
    for text in texts:
        ws = words(text)
        sizes.append(len(ws))
        parts += [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)), zero]
    return np.concatenate([*parts, zero]), np.cumsum([0] + [s + 1 for s in sizes[:-1]]), sizes


def _shard(block: TestSuffixes, texts: list[bytes | None]) -> list[tuple[int, list, list, int]]:
    """(words, spans, items, longest match of at least a window) of each text."""
    ids, begin, sizes = _layout(block, texts)
    out = [(s, [], [], 0) for s in sizes]
    array = suffix_array(ids, block.deepest)
    best, _ = block.longest(ids, array)
    at, window = block.occurrences(ids, array, best)
    if not len(at):
        return out
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.lengths[window], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])))
    spans = edges.reshape(-1, 2)
    of = np.searchsorted(begin, at, "right") - 1
    # documents by window, then by item
    pairs = np.unique(np.stack([of, window], 1), axis=0)
    lo, hi = np.searchsorted(block.owners[:, 0], pairs[:, 1], "left"), np.searchsorted(block.owners[:, 0], pairs[:, 1], "right")
    items = block.owners[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo), 1]
    listed = defaultdict(set)
    for d, i in np.unique(np.stack([np.repeat(pairs[:, 0], hi - lo), items], 1), axis=0).tolist():
        if block.names[i] is not None:
            listed[d].add(block.names[i])
    # the longest match at a hit place is that of the training suffix among the test suffixes
    places = np.unique(at)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(begin, places, "right") - 1, block.depth_of(ids, places))
    for d, (s, e) in zip((np.searchsorted(begin, spans[:, 0], "right") - 1).tolist(), spans.tolist()):
        out[d][1].append((s - int(begin[d]), e - s))
    return [(n, sp, sorted(listed[d]), int(longest[d])) for d, (n, sp, _, _) in enumerate(out)]


def _merged(a: list, b: list) -> list:
    out: list = []
    for s, n in sorted([*a, *b]):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n - out[-1][0]))
        else:
            out.append((s, n))
    return out


def _benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes``; equal texts of a block are sent as they are."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted(((r[0], r[1].encode() if r[1] is not None else None) for r in part.collect()), key=lambda r: (r[0] or "", r[1] or b""))


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, offset, length, doc_id, start: of every suffix of the benchmark, its longest verbatim match over all shards and where it lies."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _benchmark_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = TestSuffixes(shared.value, WINDOW)
            top = [(0, None, None)] * len(block.at)
            for batch in batches:
                for ids, texts in _shards(batch):
                    flat, begin, _ = _layout(block, texts)
                    best, place = block.longest(flat, suffix_array(flat, block.deepest))
                    for j in np.flatnonzero(best >= np.maximum([t[0] for t in top], 1)).tolist() if len(top) else []:
                        d = int(np.searchsorted(begin, place[j], "right") - 1)
                        if best[j] > top[j][0] or (ids[d] is not None and (top[j][1] is None or ids[d] < top[j][1])):
                            top[j] = (int(best[j]), ids[d], int(place[j] - begin[d]))
            found = [(block.names[block.item[j]], block.offset[j], *t) for j, t in enumerate(top) if t[0]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["item_id", "offset", "length", "doc_id", "start"])

        part = rows.mapInArrow(run, "item_id string, offset long, length long, doc_id long, start long")
        out = part if out is None else out.unionAll(part)
    best = out.groupBy("item_id", "offset").agg(F.max(F.struct("length", -F.col("doc_id"), -F.col("start"), "doc_id", "start")).alias("m"))
    return best.select("item_id", "offset", "m.length", "m.doc_id", "m.start")


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of shards of about ``SHARD_BYTES``."""
    ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
    texts, part, size = batch.column("text").cast(pa.large_binary()), [], 0
    for i in range(batch.num_rows):
        part.append(texts[i].as_py())
        size += len(part[-1] or b"")
        if size >= SHARD_BYTES:
            yield ids[i + 1 - len(part) : i + 1], part
            part, size = [], 0
    if part:
        yield ids[batch.num_rows - len(part) :], part


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (first word and length in words, apart and in order), item_ids, and longest_match (in words, 0 without a window)."""
    spark = docs.sparkSession
    out, first = docs, True
    for rows in _benchmark_blocks(benchmark, block_bytes):
        out = out if first else cut(out)
        shared = spark.sparkContext.broadcast(rows)

        def make(shared=shared, first=first):
            block = TestSuffixes(shared.value, window)

            def each(batch: pa.RecordBatch) -> list:
                got = [x for _, texts in _shards(batch) for x in _shard(block, texts)]
                if not first:
                    old = zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), batch.column("longest_match").to_pylist())
                    got = [(n, _merged([(x["start"], x["length"]) for x in s0], s), sorted({*i0, *i}), max(m0, m)) for (n, s, i, m), (s0, i0, m0) in zip(got, old)]
                spans = [[{"start": s, "length": k} for s, k in g[1]] for g in got]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                return [pa.array([g[0] for g in got], pa.int64()), pa.array(spans, kind), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.int64())]

            return each

        out, first = append_columns(out, make, FIELDS), False
    return out


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return unwrapped(matches(wrapped(docs), benchmark, window).where(F.size("hit_spans") == 0), docs)
