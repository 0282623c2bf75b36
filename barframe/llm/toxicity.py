"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and stems whose continuations vary, that stand in toxic texts only or
nearly so, in several different contexts (so that copies of one text prove nothing). The trie of the lexicon is intersected
with the Levenshtein automaton of each term's distance; the subset construction gives one deterministic automaton,
which all tokens of a batch walk together. A hit's window of neighbours tells quotation (quotation marks around it, a
reporting word before it) from abuse, and a logistic model weighs exact, misspelled and quoted hits.

Training reads a bounded sample of labelled rows, scoring whole texts, however long. The weights are fitted on hits of a lexicon that other
rows taught: each half of the sample is scanned with the lexicon of the other half; the lexicon that is used comes from all rows.
Null, empty and wordless texts have no hits and get the model's score for that. Without labels of both classes every score is 0.
Repeated rows get the same score each; an empty table gives an empty result. Columns named like a result are replaced by it, in ``reject`` kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, labelled_texts, unwrapped, wrapped

#: Labelled rows of the training sample, characters of all its texts, and terms of the lexicon.
TRAIN_ROWS, TRAIN_CHARS, TERMS = 4000, 40_000_000, 400
LEAST_CONTEXTS, PURITY, STEM = 5, 0.95, 4
WINDOW, THRESHOLD = 4, 0.3
PART_CHARS, KNOWN = 1 << 20, 300_000
_QUOTES = "\"“”«»„‟"
_REPORTING = frozenset("said says quote quoted quotes wrote called reported replied".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    """A token without the signs at its ends."""
    return token if token.isalnum() else _EDGE.sub("", token)


def distance_of(term: str, stem: bool) -> int:
    n = len(term)
    return (0 if n < 7 else 1) if stem else (0 if n < 5 else 1 if n < 9 else 2)


def learn_lexicon(sample: list[tuple[str, int]], terms: int = TERMS) -> list[tuple[str, bool]]:
    """(term, is a stem) of the terms that mark toxic texts."""
    contexts: dict[str, set] = defaultdict(set)
    clean: Counter = Counter()
    tails: dict[str, set] = defaultdict(set)
    plain: Counter = Counter()
    for text, label in sorted(set(sample)):
        words = [bare(w) for w in tokens(text)]
        if not label:
            plain.update(set(words))
            continue
        for i, w in enumerate(words):
            if len(w) >= STEM and w[0].isalpha():
                near = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                for k in range(STEM, min(len(w), 12) + 1):
                    contexts[w[:k]].add(near)
                    tails[w[:k]].add(w)
    for w, n in plain.items():
        for k in range(STEM, min(len(w), 12) + 1):
            if w[:k] in contexts:
                clean[w[:k]] += n
    good = {p for p, c in contexts.items() if len(c) >= LEAST_CONTEXTS and len(c) >= PURITY * (len(c) + clean[p])}
    found: dict[str, tuple[int, bool]] = {}
    for p in sorted(good, key=lambda x: (len(x), x)):
        if any(p[:k] in good for k in range(STEM, len(p))):
            continue
        words = tails[p]
        common = min(words)[: len(_common(min(words), max(words)))]
        stem = len(words) > 1
        # most continuations are one word: the rest are misspellings or compounds of it
        top = Counter()
        for w in words:
            top[w] = len(contexts.get(w[:12], ()))
        word, n = max(top.items(), key=lambda x: (x[1], x[0]))
        if n >= 0.7 * len(contexts[p]):
            found[word] = (len(contexts[p]), False)
        else:
            found[common] = (len(contexts[p]), stem)
    best = sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:terms]
    return sorted((t, s) for t, (_, s) in best)


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


class Automaton:
    """The deterministic automaton of all tokens within each term's distance of a lexicon term (of its beginning for stems)."""

    def __init__(self, lexicon: list[tuple[str, bool]]):
        self.lexicon = lexicon
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        reach = [0]
        for t, (term, stem) in enumerate(lexicon):
            node, d = 0, distance_of(term, stem)
            reach[0] = max(reach[0], d)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], d)
            ends[node].append(t)
        letters = sorted({c for term, _ in lexicon for c in term})
        self.codes = {c: i + 2 for i, c in enumerate(letters)}  # 0: no more characters, 1: any other character
        width = len(letters) + 2

        def closed(states: dict[int, int]) -> frozenset:
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                if states[node] < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= reach[child] and states.get(child, 9) > e + 1:
                        states[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(states.items())

        def verdict(state: frozenset) -> tuple[int, bool]:
            """Least distance plus one of an accepted term, and whether a stem is complete."""
            best, stem = 0, False
            for node, e in state:
                for t in ends[node]:
                    if e <= distance_of(*lexicon[t]):
                        best = min(best or 9, e + 1)
                        stem |= lexicon[t][1]
            return best, stem

        start = closed({0: 0})
        number, order, rows, accept, held = {start: 0}, [start], [], [], []
        i = 0
        while i < len(order):
            state = order[i]
            best, stem = verdict(state)
            accept.append(best)
            held.append(stem)
            row = [i] * width
            if not stem:  # a complete stem accepts whatever follows
                for c, code in [("", 1), *self.codes.items()]:
                    after: dict[int, int] = {}
                    for node, e in state:
                        if e + 1 <= reach[node]:
                            after[node] = min(after.get(node, 9), e + 1)
                        for x, child in children[node].items():
                            cost = e + (x != c)
                            if cost <= reach[child]:
                                after[child] = min(after.get(child, 9), cost)
                    nxt = closed(after)
                    if nxt not in number:
                        number[nxt] = len(order)
                        order.append(nxt)
                    row[code] = number[nxt]
            rows.append(row)
            i += 1
        self.table, self.accept = np.array(rows, np.int32), np.array(accept, np.int8)
        self.map = np.ones(0x250, np.int32)
        self.map[0] = 0
        for c, code in self.codes.items():
            if ord(c) < 0x250:
                self.map[ord(c)] = code
        # letters is sorted, so the wide ones are its tail
        self.wide = np.array([ord(c) for c in letters if ord(c) >= 0x250], np.uint32)
        self.wide_codes = np.array([self.codes[chr(c)] for c in self.wide], np.int32)

    def distances(self, words: list[str]) -> np.ndarray:
        """0 for no hit, else the distance plus one."""
        out = np.zeros(len(words), np.int8)
        size = np.array([len(w) for w in words])
        for low, high in ((1, 12), (13, 24), (25, 64)):
            at = np.flatnonzero((size >= low) & (size <= high))
            if len(at):
                chars = np.array([words[i] for i in at], f"U{high}").view(np.uint32).reshape(len(at), high)
                codes = np.where(chars < 0x250, self.map[np.minimum(chars, 0x24F)], 1)
                if len(self.wide):
                    wide = np.nonzero(chars >= 0x250)
                    place = np.minimum(np.searchsorted(self.wide, chars[wide]), len(self.wide) - 1)
                    codes[wide] = np.where(self.wide[place] == chars[wide], self.wide_codes[place], 1)
                state = np.zeros(len(at), np.int32)
                for k in range(high):
                    state = self.table[state, codes[:, k]]
                out[at] = self.accept[state]
        for i in np.flatnonzero(size > 64):
            state = 0
            for c in words[i]:
                state = self.table[state, self.codes.get(c, 1)]
            out[i] = self.accept[state]
        return out


class Scanner:
    """Hits of whole texts; tokens that were looked up before are remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.hits, self.clean = automaton, {}, set()

    def features(self, texts) -> np.ndarray:
        """One row for each text of a list or an Arrow array."""
        out, part, size = [], [], 0
        for t in texts:
            t = t.as_py() if isinstance(t, pa.Scalar) else t
            part.append(tokens(t) if t else [])
            size += len(t or "")
            if size >= PART_CHARS:
                out += self._part(part)
                part, size = [], 0
        out += self._part(part) if part else []
        return np.array(out, float).reshape(len(out), FEATURES)

    def _part(self, docs: list[list[str]]) -> list[list[float]]:
        seen = [set(d) for d in docs]
        new = list(set().union(*seen) - self.clean - self.hits.keys())
        found = self.automaton.distances([bare(w) for w in new])
        if len(self.clean) > KNOWN:
            self.clean.clear()
        for i in np.flatnonzero(found):
            self.hits[new[i]] = int(found[i]) - 1
        self.clean.update(w for w, d in zip(new, found.tolist()) if not d)
        return [[0.0] * FEATURES if self.hits.keys().isdisjoint(s) else self._hits(d) for d, s in zip(docs, seen)]

    def _hits(self, words: list[str]) -> list[float]:
        exact = fuzzy = quoted = 0
        which = set()
        for i, w in enumerate(words):
            d = self.hits.get(w)
            if d is None:
                continue
            which.add(bare(w))
            before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
            opened = any(x[0] in _QUOTES for x in before) and any(x.rstrip(".,;:!?")[-1:] in _QUOTES and x.rstrip(".,;:!?") for x in after)
            if opened or any(bare(x) in _REPORTING for x in before[:-1]):
                quoted += 1
            elif d:
                fuzzy += 1
            else:
                exact += 1
        n = exact + fuzzy
        return [float(exact > 0), np.log1p(exact), float(fuzzy > 0), np.log1p(fuzzy), float(quoted > 0), np.log1p(quoted), np.log1p(100 * n / len(words)), np.log1p(len(which))]


FEATURES = 8


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the last of them the constant, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """lexicon and weights from a bounded sample; no row is weighed by a lexicon that it taught."""
    sample = labelled_texts(docs, labels, label, rows, keep, TRAIN_CHARS)
    y = np.array([t[1] for t in sample], float)
    if not len(y) or y.min() == y.max():
        return {"lexicon": [], "weights": None}
    x = np.zeros((len(sample), FEATURES))
    for half in range(2):
        other = Scanner(Automaton(learn_lexicon(sample[1 - half :: 2])))
        x[half::2] = other.features([t[0] for t in sample[half::2]])
    return {"lexicon": learn_lexicon(sample), "weights": fit_logistic(x, y).tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with tox_score (0 to 1) and tox_hits (exact, misspelled and quoted hits as one list)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        lexicon, weights = shared.value["lexicon"], shared.value["weights"]
        scanner = Scanner(Automaton(lexicon)) if weights else None

        def each(batch: pa.RecordBatch) -> list:
            if scanner is None:
                return [pa.array(np.zeros(batch.num_rows)), pa.array([[0, 0, 0]] * batch.num_rows, pa.list_(pa.int64()))]
            x = scanner.features(batch.column("text"))
            z = x @ np.array(weights[:-1]) + weights[-1]
            counts = np.rint(np.expm1(x[:, [1, 3, 5]])).astype(np.int64)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(counts.tolist(), pa.list_(pa.int64()))]

        return each

    fields = [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_hits", T.ArrayType(T.LongType()))]
    return append_columns(docs, make, fields)


def reject(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns."""
    return unwrapped(score(wrapped(docs), model).where(F.col("tox_score") < threshold), docs)
