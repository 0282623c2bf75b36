"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document is tokenised and closed with an end id. Whole windows are cut off a long document; the rest is cut into
chunks of at most ``chunk`` ids. Chunks are gathered until they fill about ``windows`` windows, and the group is
partitioned by multiway differencing: each chunk starts as a partial partition with one loaded window, and the two partial
partitions with the largest imbalance are merged heavy against light until one is left, whose windows are nearly
equal. If a window exceeds the capacity, the window count rises and the group is partitioned again.

Groups are filled and closed within a task, so no row moves and a task that is run again gives the same rows. Sequence ids
are made of the partition's number and a count within it. A null text is an empty one: its only id is the end id.
Repeated documents are packed as often as they occur; chunks of equal size keep their order. An empty table gives no piece. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import kept, trim

CAPACITY = 2048
WINDOWS = 128
CHUNK = 512
END_ID = 1
CACHE_PIECES, OUT_ROWS = 100_000, 1024

#: Characters that Python's and the tokenizer's classes of letters, digits and white space agree on.
_ODD = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-Ɂ]")
_PIECES = re.compile(
    "'(?:[stmd]|re|ve|ll)| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-Ɂ]+| ?[0-9]+"
    "| ?[^ \t\n\r\f\v0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-Ɂ]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)


class Tokens:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the ``tokenizers`` file gives them.

    Ids are kept by pre-token, since the vocabulary's merges never cross one. ``ranks`` is the same vocabulary for
    the fast piece encoder; texts with characters outside the Latin blocks go to ``tokenizers`` whole.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.piece = None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.piece = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if self.piece is None or _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        cache, out = self.cache, _PIECES.findall(text)
        new = [p for p in set(out) if p not in cache]
        if new:
            if len(cache) > CACHE_PIECES:
                cache.clear()
                new = set(out)
            for p in new:
                cache[p] = np.array(self.piece(p.encode()), "<u4").tobytes()
        return b"".join(map(cache.__getitem__, out))


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of nearly equal sums."""
    empty = [(0, None)] * (k - 1)
    heap = [(-s, i, [(s, i), *empty]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, order, b = heapq.heappop(heap)
        merged = [(x + y, n if m is None else m if n is None else (m, n)) for (x, m), (y, n) in zip(a, reversed(b))]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0]
        if low:
            merged = [(x - low, m) for x, m in merged]
        heapq.heappush(heap, (-merged[0][0], order, merged))
    out = []
    for _, tree in heap[0][2]:
        stack, members = [tree] if tree is not None else [], []
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                members.append(t)
        out.append(sorted(members))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows from the least count on whose differencing keeps within the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = karmarkar_karp(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        k += 1


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, chunk: int = CHUNK, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary, ranks)
        base, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        held: list[tuple] = []  # chunks: (doc_id, start, length, bytes, doc_tokens)
        load = 0

        def put(piece: tuple, sequence: int, offset: int) -> None:
            doc, start, length, body, total = piece
            rows.append((doc, start, length, zlib.crc32(body), total, sequence, offset, body))

        def close() -> None:
            nonlocal made, load
            if not held:
                return
            for members in windows_of([p[2] for p in held], capacity):
                offset = 0
                for i in members:
                    put(held[i], base + made, offset)
                    offset += held[i][2]
                made += 1
            held.clear()
            load = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            if with_ids:
                flat = np.frombuffer(b"".join(r[7] for r in rows), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32)), pa.array(flat)))
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                body = tokens(text.as_py() or "") + end
                total = len(body) // 4
                start = 0
                while total - start >= capacity:
                    put((doc, start, capacity, body[4 * start : 4 * (start + capacity)], total), base + made, 0)
                    made, start = made + 1, start + capacity
                while start < total:
                    n = min(chunk, total - start)
                    room = windows * capacity - load
                    n = min(n, room)
                    held.append((doc, start, n, body[4 * start : 4 * (start + n)], total))
                    start, load = start + n, load + n
                    if load == windows * capacity:
                        close()
                if len(rows) >= OUT_ROWS:
                    yield out()
        close()
        if rows:
            yield out()
        trim()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _tokens(vocabulary: str, ranks: str | None) -> Tokens:
    """One encoder for each Python worker, its cache kept between tasks of this operator."""
    return kept(("tokens", vocabulary, ranks), lambda: Tokens(vocabulary, ranks))
