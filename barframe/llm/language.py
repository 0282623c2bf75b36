"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: runs of two to four bytes within a word or over its edge, A-Z
lower-cased, hashed into ``BUCKETS`` rows. Embeddings and softmax are trained together by mini-batch stochastic
gradient descent in numpy; since both are linear, scoring needs one weight per bucket and language. A temperature is
fitted on a tenth of the rows, which the descent does not see, and on another tenth the rejection threshold: the least confidence from
which on those rows are right in the share asked for. The prediction below it stays and is marked as rejected; where no confidence gives that
share, or fewer than ``LEAST_KEPT`` rows are there to show it, every row is rejected.

Training reads a bounded sample of labelled rows, scoring whole texts, however long. Null texts and texts without a letter are ``und``
with score 0 and rejected. Without labelled rows every text is ``und``; an empty table gives an empty result. Repeated rows get the same
answer each, equally likely languages the first by name. Columns named like a result are replaced by it; others are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, bounded_texts, doc_text, sample_ids

#: Rows of the training sample, and characters of all its texts.
TRAIN_ROWS, TRAIN_CHARS = 2500, 30_000_000
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 12, 16, 12, 32, 4.0
PRECISION, LEAST_KEPT = 0.99, 5
REJECT_ALL = 2.0
_BITS = BUCKETS.bit_length() - 1
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def histogram(text: bytes) -> np.ndarray:
    """Shares of the hashed subwords of a text."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    letter = b != 32
    total = np.zeros(BUCKETS)
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        inner = np.ones(m, bool)
        for k in range(n):
            h = (h ^ b[k : k + m]) * np.uint32(16777619)
            if 0 < k < n - 1:
                inner &= letter[k : k + m]
        ok = inner & (letter[:m] | letter[n - 1 :])
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        total += np.bincount(h[ok], minlength=BUCKETS)
    return total / max(total.sum(), 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """languages, weights (bucket by language), temperature, rejection threshold."""
    names = sorted(set(langs))
    if not names:
        return {"languages": []}
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    x = np.array([histogram(t.encode()) for t in texts], np.float32)
    order = rng.permutation(len(y))
    tenth = max(len(y) // 10, min(LEAST_KEPT, len(y) // 4))
    tuned, kept, learn = order[:tenth], order[tenth : 2 * tenth], order[2 * tenth :]
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    head = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 4)  # averages of many rows are small
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for s in range(0, len(learn), BATCH):
            at = learn[s : s + BATCH]
            mean = x[at] @ table * scale
            g = _softmax(mean @ head)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            down = g @ head.T
            head -= np.float32(rate * 0.1) * (mean.T @ g)
            table -= np.float32(rate) * (x[at].T @ down) * scale
    weights = (table @ head * scale).astype(float)
    temperature = fit_temperature(x[tuned] @ weights, y[tuned]) if tenth else 1.0
    p = _softmax(x[kept] @ weights / temperature)
    return {"languages": names, "weights": weights, "temperature": temperature, "threshold": rejection(p.max(axis=1), p.argmax(axis=1) == y[kept])}


def fit_temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least log loss."""
    grid = np.geomspace(0.2, 10, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def rejection(sure: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least confidence from which on the share of right rows is at least ``precision``; above 1 where there is none."""
    if len(sure) < LEAST_KEPT:
        return REJECT_ALL
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(sure) + 1)
    last = np.append(sure[order][1:] < sure[order][:-1], True)  # rows of one confidence pass together
    ok = np.flatnonzero((share >= precision) & last)
    return float(sure[order][ok[-1]]) if len(ok) else REJECT_ALL


def train(docs: DataFrame, keep: Column, rows: int = TRAIN_ROWS) -> dict:
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & keep)
    got = bounded_texts(sample_ids(named.select("doc_id", "text", F.col("lang").cast("string").alias("label")), rows), rows, TRAIN_CHARS)
    got = [r for r in got if has_letter(r[0])]
    return fit([t for t, _ in got], [x for _, x in got])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = m["languages"]

        def each(batch: pa.RecordBatch) -> list:
            pred, score = [], []
            for t in batch.column("text"):
                t = t.as_py()
                if not names or not has_letter(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                p = _softmax((histogram(t.encode()) @ m["weights"] / m["temperature"])[None, :])[0]
                pred.append(names[int(p.argmax())])
                score.append(float(p.max()))
            low = m.get("threshold", 1.0)
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([x == "und" or s < low for x, s in zip(pred, score)], pa.bool_())]

        return each

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, make, fields)


def identify(docs: DataFrame, keep: Column) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every text, by a model of the rows that ``keep`` admits."""
    model = train(docs, keep)
    return predict(doc_text(docs), model)
