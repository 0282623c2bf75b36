"""Quality by a sparse rule ensemble over text statistics.

Shallow boosted trees on the statistics of labelled texts propose rules: every path from a root is a conjunction of
comparisons. A lasso logistic regression over the rules, solved by accelerated proximal steps, keeps few of them, and those are
compiled into one Spark column expression over the statistics.

Training reads a bounded sample of labelled rows, scoring whole texts, however long. Null texts count as empty, all of whose statistics
are 0. Without labels of both classes every score is the share of label 1 (0 without labels). Repeated rows get the same score each; an
empty table gives an empty result. Columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, labelled_texts

#: Labelled rows of the training sample, and characters of all its texts.
TRAIN_ROWS, TRAIN_CHARS = 4000, 40_000_000
TREES, DEPTH, LEAF, SHRINK, BINS = 40, 3, 15, 0.3, 32
LASSO, STEPS = 0.002, 400
STATS = ("chars", "words", "mean_word", "symbols", "marks", "upper_words", "digits", "bars", "top_word", "repeats", "distinct", "lines", "same_lines", "top_line", "odd_ends", "no_letters")

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS, _SPACES, _MARKS = b"0123456789", b" \t\n\r\v\f", b".,;:!?'\"()-"


def statistics(text: str | None) -> list[float]:
    """The values of STATS for a whole text."""
    if not text or not text.strip():
        return [0.0] * len(STATS)
    b, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x.strip()]
    n, w = len(b), len(words)
    letters, digits, spaces, marks = (n - len(b.translate(None, x)) for x in (_LETTERS, _DIGITS, _SPACES, _MARKS))
    counts, rows = Counter(words), Counter(lines)
    return [
        np.log1p(n), np.log1p(w), (n - spaces) / w, (n - letters - digits - spaces - marks) / n, marks / n,
        sum(map(str.isupper, words)) / w, digits / n, b.count(b"|") / w, counts.most_common(1)[0][1] / w if w > 9 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / w, len(counts) / w, np.log1p(len(lines)), 1 - len(rows) / len(lines), max(rows.values()) if len(lines) > 1 else 1,
        sum(not x[-1].isalnum() for x in words) / w, 1 - letters / n,
    ]


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray) -> None:
    """Grows one tree on gradients, adds its paths to ``rules`` and its leaf values to ``out``."""
    best = (1e-6, -1, -1)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAF:
        base = total_g**2 / (total_h + 1)
        for j in range(binned.shape[1]):
            b = binned[rows, j]
            gs = np.cumsum(np.bincount(b, g[rows], BINS))[:-1]
            hs = np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - base
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(edges[j]):
                best = (gain[k], j, k)
    _, j, k = best
    if path:
        rules.add(tuple(sorted(path)))
    if j < 0:
        out[rows] = -total_g / (total_h + 1)
        return
    left = binned[rows, j] <= k
    value = float(edges[j][k])
    _tree(binned, edges, g, h, rows[left], depth - 1, (*path, (j, "<=", value)), rules, out)
    _tree(binned, edges, g, h, rows[~left], depth - 1, (*path, (j, ">", value)), rules, out)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    rules: set = set()
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        out = np.zeros(len(y))
        _tree(binned, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), rules, out)
        z += SHRINK * out
    return sorted(rules)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, op, v in rule:
        ok &= x[:, j] <= v if op == "<=" else x[:, j] > v
    return ok


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant of the penalised logistic regression, by FISTA."""
    n = len(y)
    rate = 4 * n / (np.linalg.eigvalsh(r.T @ r)[-1] + n)
    w = v = np.zeros(r.shape[1])
    c = d = np.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ v + d))) - y
        new = v - rate * (r.T @ e / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        const = d - rate * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, d = new + (t - 1) / t2 * (new - w), const + (t - 1) / t2 * (const - c)
        w, c, t = new, const, t2
    return w, float(c)


def fit(sample: list[tuple[str, int]]) -> dict:
    """rules [(conditions, weight)] and constant."""
    y = np.array([q for _, q in sample], float)
    if not len(y) or y.min() == y.max():
        return {"rules": [], "constant": None, "share": float(y.mean()) if len(y) else 0.0}
    x = np.array([statistics(t) for t, _ in sample])
    rules = extract_rules(x, y)
    fired = np.stack([holds(r, x) for r in rules], 1)
    _, once = np.unique(fired, axis=1, return_index=True)
    rules, fired = [rules[i] for i in sorted(once)], fired[:, sorted(once)].astype(float)
    w, c = lasso_logistic(fired, y, LASSO)
    return {"rules": [(r, float(a)) for r, a in zip(rules, w) if a], "constant": c}


def compile_rules(model: dict, stats: str = "stats") -> Column:
    """The score as one expression over the struct of statistics."""
    if model["constant"] is None:
        return F.lit(model["share"])
    z = F.lit(model["constant"])
    for rule, weight in model["rules"]:
        cond = None
        for j, op, v in rule:
            one = F.col(stats)[STATS[j]] <= F.lit(v) if op == "<=" else F.col(stats)[STATS[j]] > F.lit(v)
            cond = one if cond is None else cond & one
        z = z + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``stats`` of the statistics of each whole text."""

    def make():
        def each(batch: pa.RecordBatch) -> list:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            cols = np.array(rows, float).reshape(len(rows), len(STATS))
            return [pa.StructArray.from_arrays([pa.array(c) for c in cols.T], names=list(STATS))]

        return each

    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])
    return append_columns(docs, make, [T.StructField("stats", kind)])


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    return fit(labelled_texts(docs, labels, label, rows, keep, TRAIN_CHARS))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with stats and quality_score."""
    return with_statistics(docs).withColumn("quality_score", compile_rules(model))
