"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form a class and only
its representative is compared. Tokens are put in one global order: tokens outside a bounded list of frequent tokens
first, listed ones last. Two sets of similarity s share a token of their first n - ceil(s n) + 1
tokens, their prefixes.

* Rare tokens of a prefix are indexed alone. A bucket of at most ``SMALL`` members is compared at once, behind a length and
  a position filter, within its task.
* Sets whose prefix reaches listed tokens, or holds a token with a larger bucket, are extended to the whole set and indexed
  by token combinations: similar sets of one band of sizes differ in at most d tokens, so if tokens are dealt by hash to
  d + 1 combinations, at least one combination is the same in both. It holds about n / (d + 1) tokens (9 at similarity 0.9), so a
  passage that many documents share is no longer enough to meet. Two sets that share a frequent token in their prefixes are
  both indexed so; any other similar pair shares a rare one. No link is lost.
* A larger bucket of combinations is not expanded: its members are paired with one hub, the member with the fewest rare
  tokens (the original where the others are edited copies). Where links join all its members it is done. Else members of
  different components are compared, in blocks; pairs inside a component cannot change the result.

Candidates pass a parity filter (the symmetric difference of two sets is at least the distance of their parity bitmaps) and are
verified on the whole sets. Verification takes the most promising partner of every document first, then ``LEVELS`` rounds of the
nearest pair of every two components, then whatever still joins different components: each pair that could change the result is
verified. Texts travel once per pair and once per ``UNIT`` partners of a hub, never as pairs of texts.

Null and wordless texts have an empty set and link with nothing; texts with fewer words than a shingle have one shingle, their
whole sequence. Repeated rows of one doc_id are nodes of their own; an empty table gives an empty result. Only doc_id and text are read, so
other columns, whatever their names, play no part. Very long texts are processed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, cut, drop, release

WORDS, SIMILARITY = 3, 90
#: Entries of the list of frequent tokens, rows in one broadcast, members of a bucket that are compared at once.
FREQUENT, BROADCAST_IDS, SMALL = 1 << 19, 1 << 17, 64
#: Least count of a token within a task to be counted at all; rounds that verify only the nearest pairs.
LEAST_COUNT, LEVELS = 2, 1
#: Bytes hashed at once, tokens counted at once, partners of a hub in one unit, members of a block, rows of texts in an Arrow batch.
PART_BYTES, COUNT_TOKENS, UNIT, BLOCK = 1 << 20, 1 << 22, 64, 1024
#: Keys of more rows are joined by broadcast (there are at most rows / HOT of them); combinations up to which empty ones count.
HOT, SURE = 1000, 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (as signed 64-bit integers) of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t or b"")
        size += len(part[-1])
        if size >= PART_BYTES:
            out += _shingles(part, words)
            part, size = [], 0
    return out + (_shingles(part, words) if part else [])


def _shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    b = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    power = np.full(len(b), _BASE, np.uint64)
    power[0] = 1
    back = np.full(len(b), _INVERSE, np.uint64)
    back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power)])
    space = np.concatenate([[True], _SPACE[b], [True]])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    word = _mix((total[end] - total[start]) * back[start]) if len(start) else np.zeros(0, np.uint64)
    h = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        h = _mix(h * _BASE + word[k : k + len(h)])
    edge = np.searchsorted(start, first)
    out = []
    for i in range(len(texts)):
        a, z = int(edge[i]), int(edge[i + 1])
        if z - a >= words:
            out.append(np.unique(h[a : z - words + 1].view(np.int64)))
        elif z > a:
            one = np.array([z - a], np.uint64)
            for w in word[a:z]:
                one = _mix(one * _BASE + w)
            out.append(one.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _marks(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    u = tokens.view(np.uint64)
    return int(_mix(u).sum(dtype=np.uint64).view(np.int64)), int(_mix(u + _BASE).sum(dtype=np.uint64).view(np.int64))


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def frequent_tokens(docs: DataFrame, words: int = WORDS, entries: int | None = None, least: int | None = None) -> np.ndarray:
    """The sorted most frequent tokens, at most ``entries`` by whole classes of frequency.

    All documents are counted, repeated texts of a batch once; a token counts from ``least`` in one run of a task on. The list only
    orders tokens: any list gives the same links.
    """
    entries, least = entries or FREQUENT, least or LEAST_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            keep = counts >= least
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(counts[keep].astype(np.int64))], names=["token", "n"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for s in shingles(list({t for t in _bytes(batch) if t}), words):
                held.append(s)
                size += len(s)
                if size >= COUNT_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)
        release()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    classes = cut(counts.where(F.col("n") >= 2 * least).select("token", F.floor(F.log2("n")).cast("int").alias("class")))
    sizes = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
    low, held = max(sizes, default=0) + 1, 0
    while low - 1 >= min(sizes, default=low) and held + sizes.get(low - 1, 0) <= entries:
        low, held = low - 1, held + sizes.get(low - 1, 0)
    tokens = classes.where(F.col("class") >= low).select("token").toArrow().column("token").to_numpy()
    drop(classes)
    return np.sort(tokens)


def prefix_keys(tokens: np.ndarray, listed: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, bool, int]:
    """The rare tokens of a set's prefix, whether the prefix reaches a listed token, and how many tokens are rare."""
    n = len(tokens)
    if n * (100 - similarity) < similarity:  # smaller sets have no similar set but their equals
        return np.zeros(0, np.int64), False, n
    p = n - -(-similarity * n // 100) + 1
    rare = tokens
    if len(listed):
        at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
        rare = tokens[listed[at] != tokens]
    return rare[:p], len(rare) < p, len(rare)


def combinations(tokens: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Keys of the token combinations of one set, for its own band of sizes and the next.

    Combinations without a token count up to ``SURE`` combinations; beyond, two similar sets have an equal one with tokens but for
    a chance below 1e-12 (all differing tokens would have to fall into different combinations).
    """
    u, n = tokens.view(np.uint64), len(tokens)
    step = 1.0001 * math.log(100 / similarity)
    band = int(math.log(n) / step)
    out = []
    for b in (band, band + 1):
        largest = math.floor(math.exp((b + 1) * step)) + 1
        parts = np.uint64(2 * largest * (100 - similarity) // (100 + similarity) + 1)
        part = (u >> np.uint64(7)) % parts
        total = np.zeros(int(parts), np.uint64)
        np.add.at(total, part.astype(np.int64), _mix(u))
        keys = _mix(total * _BASE + _mix(np.arange(int(parts), dtype=np.uint64) + np.uint64(b << 32)))
        out.append(keys if parts <= SURE else keys[np.bincount(part.astype(np.int64), minlength=int(parts)) > 0])
    return np.concatenate(out).view(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of the parities of a set's counts by hash; its size is a power of two of at least twice the set's, 128 to 65536 bits."""
    bits = min(max(128, 1 << (2 * len(tokens) - 1).bit_length()), 1 << 16)
    at = ((tokens.view(np.uint64) >> np.uint64(23)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """The distance of two bitmaps, the larger folded to the size of the smaller; at most the sets' symmetric difference."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, k = len(a), len(b)
    while m > k:
        m //= 2
        x = (x >> 8 * m) ^ (x & ((1 << 8 * m) - 1))
    while k > m:
        k //= 2
        y = (y >> 8 * k) ^ (y & ((1 << 8 * k) - 1))
    return (x ^ y).bit_count()


def _longs(rows: list, names: list[str]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[:, j])) for j in range(len(names))], names=names)


def _indexed(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """node, doc_id, mark (a hash of the text), n, s1, s2, odd (rare tokens), keys (rare tokens of the prefix) and often (it reaches listed ones) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.asarray(shared.value, np.int64)
        for batch in batches:
            sets = shingles(_bytes(batch), words)
            marks = [_marks(s) for s in sets]
            found = [prefix_keys(s, listed, similarity) for s in sets]
            off = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            keys = pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])))
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks], [f[2] for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *numbers, keys, pa.array([f[1] for f in found], pa.bool_())], names=["doc_id", "mark", "n", "s1", "s2", "odd", "keys", "often"])
        release()

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, s1 long, s2 long, odd long, keys array<long>, often boolean")
    return cut(rows.withColumn("node", F.monotonically_increasing_id()))


def _few(ids: DataFrame) -> DataFrame:
    """A broadcast where the rows' count allows it, else a plain join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _joined(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key; rows of the ``hot`` keys (a bounded table) stay where they are."""
    few = side.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(side, key))


def _hot(counts: DataFrame, key: str) -> DataFrame:
    """The keys of more than ``HOT`` rows: at most rows / HOT of them."""
    return cut(counts.where(F.col("count") > HOT).select(key))


def _similar(n: Column, m: Column, overlap: Column, similarity: int) -> Column:
    return (100 + similarity) * overlap >= similarity * (n + m)


def _bucket_pairs(postings: DataFrame, similarity: int) -> DataFrame:
    """a, b of the members of small buckets (key, node, n, place) that pass the length and position filter; b is null for each member of a larger one."""
    small = SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(keys: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(begin, len(keys)))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in np.unique(size[(size > 1) & (size <= small)]):
                at = begin[size == m][:, None]
                i, j = np.triu_indices(m, 1)
                x, y = (at + i).ravel(), (at + j).ravel()
                ok = (100 + similarity) * np.minimum(n[x] - place[x], n[y] - place[y]) >= similarity * (n[x] + n[y])
                x, y = node[x[ok]], node[y[ok]]
                left.append(np.minimum(x, y))
                right.append(np.maximum(x, y))
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            crowd = np.unique(node[np.repeat(size > small, size)])
            if len(both) or len(crowd):
                a, b = np.concatenate([both[:, 0], crowd]), np.concatenate([both[:, 1], crowd])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=a == b)], names=["a", "b"])

        held: list[np.ndarray] | None = None  # a bucket that goes on in the next batch
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "node", "n", "place")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]):
                last = int(np.searchsorted(held[0], held[0][-1]))
                if last:
                    yield from pairs(*[x[:last] for x in held])
                held = [x[last:] for x in held]
                if len(held[0]) > 4 * small:  # known to be large: its members go as they come
                    yield from pairs(*[x[: -small - 1] for x in held])
                    held = [x[-small - 1 :] for x in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)
        release()

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` (node and others) with the node's text."""
    told = wanted.join(known.select("node", "doc_id", "mark"), "node")
    told = _few(cut(told))
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
    return texts.join(told, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("mark"))).select(*wanted.columns, "text")


def _combined(docs: DataFrame, known: DataFrame, nodes: DataFrame, words: int, similarity: int) -> DataFrame:
    """node, n, odd and the keys of the token combinations of the nodes' whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [combinations(s, similarity) if len(s) else s for s in shingles(_bytes(batch), words)]
            off = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            keys = pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "n", "odd")], keys], names=["node", "n", "odd", "keys"])
        release()

    texts = _texts(docs, known, nodes)
    return cut(texts.mapInArrow(run, "node long, n long, odd long, keys array<long>").dropDuplicates(["node"]))


def _bitmaps(docs: DataFrame, known: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n and the parity bitmap of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parity(s) for s in shingles(_bytes(batch), words)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(bits, pa.binary())], names=["node", "n", "bits"])
        release()

    return cut(_texts(docs, known, nodes).mapInArrow(run, "node long, n long, bits binary").dropDuplicates(["node"]))


def _near(pairs: DataFrame, bitmaps: DataFrame, similarity: int) -> DataFrame:
    """a, b, apart of the pairs that pass the length and the parity filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, distance(x, y), n + m) for a, b, x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "bits_a", "bits_b", "na", "nb")])]
            yield _longs([r[:3] for r in rows if (100 + similarity) * r[2] <= (100 - similarity) * r[3]], ["a", "b", "apart"])
        release()

    one = bitmaps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = bitmaps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    both = pairs.join(one, "a").join(two, "b").where(_similar(F.col("na"), F.col("nb"), F.least("na", "nb"), similarity))
    return both.mapInArrow(run, "a long, b long, apart long")


def _verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, words: int, similarity: int) -> DataFrame:
    """a, b, linked: the pairs, compared on whole sets.

    A hub's partners are dealt to units of about ``UNIT``; each unit gets the hub's text once.
    """
    hubs = cut(pairs.groupBy("a").count())
    dealt = cut(_joined(pairs.select("a", "b"), hubs, "a", _hot(hubs, "a")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / UNIT)).alias("unit")))
    wanted = dealt.select(F.col("b").alias("node"), "a", "unit", F.lit(1).alias("role")).unionAll(dealt.select(F.col("a").alias("node"), "a", "unit", F.lit(0)).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            rows = []
            sets = iter(shingles(_bytes(batch), words))
            for node, a, unit, role in zip(*[batch.column(c).to_pylist() for c in ("node", "a", "unit", "role")]):
                own = next(sets)
                if role == 0:
                    at, hub = (a, unit), own
                elif at == (a, unit):
                    shared = len(np.intersect1d(own, hub, assume_unique=True))
                    rows.append((a, node, (100 + similarity) * shared >= similarity * (len(own) + len(hub))))
            yield _longs(rows, ["a", "b", "linked"])
        release()

    texts = _texts(docs, known, wanted).repartition("a", "unit").sortWithinPartitions("a", "unit", "role")
    out = cut(texts.mapInArrow(run, "a long, b long, linked long").select("a", "b", (F.col("linked") == 1).alias("linked")).dropDuplicates(["a", "b"]))
    drop(dealt)
    return out


def _crossing(pairs: DataFrame, graph: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not known to be in one component, with both components."""
    if graph is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    of = graph.select(F.col("node"), "component")
    both = pairs.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    return both.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca != cb")


def _unfinished(buckets: DataFrame, bitmaps: DataFrame, graph: DataFrame | None, similarity: int) -> DataFrame | None:
    """a, b, apart: near pairs of members of different components in the larger buckets.

    Members are dealt to blocks of about ``BLOCK`` by hash. A member outside its bucket's largest component meets every block of the bucket,
    the others only their own: they are compared with those alone.
    """
    of = buckets.select("key", "node")
    of = of.withColumn("component", F.col("node")) if graph is None else of.join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = cut(of)
    counts = of.groupBy("key", "component").count()
    most = counts.groupBy("key").agg(F.max_by("component", "count").alias("largest"), F.sum("count").alias("members"), F.count("*").alias("components")).where("components > 1")
    rows = cut(of.join(most, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("open", F.col("component") != F.col("largest")))
    drop(of)
    if rows.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = rows.withColumn("own", own).withColumn("block", F.explode(F.when(F.col("open"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))))
    placed = placed.select("key", "block", "node", "component", "open", (F.col("own") == F.col("block")).alias("home")).join(bitmaps, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held = None, [], []

        def compared() -> Iterator[pa.RecordBatch]:
            """Open members (first in their block) against all that are at home in it."""
            size = min(len(x[3]) for x in held + asked)  # either may be the smaller
            fold = lambda bits: np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)
            bits = np.stack([fold(x[3]) for x in held])
            wide = bits.view(np.uint64)
            node, component, n = (np.array([x[j] for x in held], np.int64) for j in range(3))
            for q in asked:
                apart = np.bitwise_count(wide ^ fold(q[3]).view(np.uint64)).sum(1).astype(np.int64)
                low = np.minimum(n, q[2])
                ok = (component != q[1]) & ((100 + similarity) * apart <= (100 - similarity) * (n + q[2])) & ((100 + similarity) * low >= similarity * (n + q[2]))
                if ok.any():
                    other = node[ok]
                    rows = np.stack([np.minimum(other, q[0]), np.maximum(other, q[0]), apart[ok]], 1)
                    yield _longs(rows, ["a", "b", "apart"])

        for batch in batches:
            for key, block, *x, is_open, home in zip(*[batch.column(c).to_pylist() for c in ("key", "block", "node", "component", "n", "bits", "open", "home")]):
                if (key, block) != at:
                    if asked and held:
                        yield from compared()
                    at, asked, held = (key, block), [], []
                if is_open:
                    asked.append(x)
                if home:
                    held.append(x)
        if asked and held:
            yield from compared()
        release()

    near = placed.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a long, b long, apart long")
    out = cut(near.groupBy("a", "b").agg(F.min("apart").alias("apart")))
    drop(rows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the edges (a, b) reaches."""
    edges = cut(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).distinct())
    hot = _hot(edges.groupBy("b").count(), "b")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = _joined(edges, labels.select(F.col("node").alias("b"), "component"), "b", hot).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        moved = cut(step.join(jump, "to", "left").select("node", "before", F.least("to", F.coalesce("root", "to")).alias("component")))
        if moved.where(F.col("before") != F.col("component")).isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def _links(docs: DataFrame, indexed: DataFrame, classes: DataFrame, words: int, similarity: int) -> DataFrame | None:
    """node, component of every representative that links with another; None where there is no link."""
    heads = indexed.join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
    known = cut(heads.where("n > 0").select("node", "doc_id", "mark", "n", "odd", "often"))
    postings = heads.select("node", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("place", "key"))
    met = cut(_bucket_pairs(postings, similarity))
    pairs = met.where("b is not null").distinct()
    nodes = cut(known.where("often").select("node").unionAll(met.where("b is null").select("a")).distinct())
    large = None
    if not nodes.isEmpty():
        combined = _combined(docs, known, known.join(nodes, "node", "left_semi").select("node", "n", "odd"), words, similarity)
        each = combined.select("node", F.col("n").cast("int").alias("n"), F.col("odd").cast("int").alias("odd"), F.explode("keys").alias("key"))
        sizes = cut(each.groupBy("key").count().where("count > 1"))
        pairs = pairs.unionAll(_bucket_pairs(each.join(sizes.where(F.col("count") <= SMALL), "key", "left_semi").select("key", "node", "n", F.lit(0).alias("place")), similarity))
        if not sizes.where(F.col("count") > SMALL).isEmpty():
            large = cut(each.join(sizes.where(F.col("count") > SMALL), "key", "left_semi"))
            hubs = large.groupBy("key").agg(F.min(F.struct("odd", "node")).alias("hub"))
            pairs = pairs.unionAll(large.join(hubs, "key").where("node != hub.node").select(F.least("node", "hub.node"), F.greatest("node", "hub.node")).distinct())
    pairs = cut(pairs.distinct())
    drop(met)
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    ends = (ends if large is None else ends.unionAll(large.select("node"))).distinct()
    bitmaps = _bitmaps(docs, known, known.join(ends, "node", "left_semi").select("node", "n"), words)
    left = cut(_near(pairs, bitmaps, similarity))
    drop(pairs)
    graph, links, level = None, None, 0
    while not left.isEmpty():
        if level == 0:  # of each document, the partner with most partners
            both = left.select("a", "b", "apart").unionAll(left.select("b", "a", "apart"))
            degree = cut(both.groupBy("b").count())
            best = _joined(both, degree, "b", _hot(degree, "b")).groupBy("a").agg(F.max(F.struct("count", -F.col("apart"), -F.col("b"), "b")).alias("to"))
            chosen = best.select(F.col("to.b").alias("a"), F.col("a").alias("b"))
        elif level <= LEVELS:  # of each two components, the nearest pair
            nearest = left.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("apart", "a", "b")).alias("to"))
            chosen = nearest.select("to.a", "to.b")
        else:
            chosen = left.select("a", "b")
        tested = _verified(docs, known, chosen, words, similarity)
        found = tested.where("linked").select("a", "b")
        links = found if links is None else cut(links.unionAll(found))
        if not found.isEmpty():
            graph = components(links)
        if level == 0 and large is not None:
            more = _unfinished(large, bitmaps, graph, similarity)
            left = left if more is None else left.unionAll(more).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = cut(_crossing(left.select("a", "b", "apart").join(done, ["a", "b"], "left_anti"), graph))
        level += 1
    return graph


def join_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, and per row its node, class (the node of its representative), component and the two hashes of its set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexed = _indexed(docs, words, similarity)
    rows = indexed.select("node", "doc_id", "n", "s1", "s2")
    classes = cut(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("members")))
    graph = _links(docs, indexed, classes, words, similarity)
    of = classes.withColumnRenamed("rep", "class")
    of = of.withColumn("component", F.col("class")) if graph is None else of.join(graph.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = cut(of.join(least, "component"))
    hot, cold = of.where(F.col("members") > HOT).drop("members", "low"), of.where(F.col("members") <= HOT).drop("members", "low")
    on, out = ["s1", "s2", "n"], ["doc_id", F.col("n").alias("n_shingles"), "component_id", "node", "class", "component", "s1", "s2"]
    some = rows.where("n > 0")
    full = some.join(F.broadcast(hot), on).select(*out).unionAll(some.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on).select(*out))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", F.col("node").alias("class"), F.col("node").alias("component"), "s1", "s2")
    return full.unionAll(empty)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents with one of each component: one row with its smallest doc_id (rows without an id or a word stay).

    Rows of one id are judged each by its own set, so texts that only share the id with a copy stay.
    """
    marked = cut(join_components(docs, words, similarity))
    repeated = cut(marked.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    gone = cut(marked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    left = docs.join(_few(gone), "doc_id", "left_anti")
    if repeated.isEmpty():
        return left
    left = left.join(_few(repeated), "doc_id", "left_anti")
    firsts = marked.where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).join(_few(repeated), "doc_id", "left_semi")
    kept = cut(firsts.groupBy("doc_id", "component").agg(F.min(F.struct("s1", "s2")).alias("set")).select("doc_id", "set.s1", "set.s2"))
    names = docs.columns
    rows = docs.join(_few(repeated), "doc_id", "left_semi").select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        def each(batch: pa.RecordBatch) -> list:
            sets = shingles(_bytes(batch), words)
            marks = [_marks(s) for s in sets]
            return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(2)]]

        return each

    told = append_columns(rows, make, [T.StructField(n, T.LongType()) for n in ("n", "s1", "s2")]).drop("text")
    once = told.where("n > 0").join(_few(kept), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    stay = told.where("n = 0").select("row").unionAll(once.select("row"))
    return left.select(*[F.col(f"`{n}`") for n in names]).unionAll(stay.select(*[F.col("row").getField(n).alias(n) for n in names]))
