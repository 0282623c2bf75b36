"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, payment cards and phone numbers of the texts. Over the
whole corpus it is counted in how many documents an entity c stands, in how many a term t, and in how many both stand
within ``window`` words. The term's disclosure is its pointwise mutual information with the entity as a share of the
entity's information content: log(p(c,t) / p(c)p(t)) / -log p(c); 1 says that the term gives the entity away. p(c,t) is
smoothed by k / (k + ``contexts``), where k is the number of different contexts that show the pair. There is no least
count: the share decides for an entity or a term that stands once, too. Terms are disclosing from ``generalise``
on and are replaced by a class label, from ``remove`` on removed: at every place in the documents that hold the entity.
In all other documents a term is removed where its largest share reaches ``remove``, that is where it alone gives an entity
away; terms between the two bounds stay there.

A null or empty text has no spans; very long texts are read whole. Copies of a passage are one context; repeated rows are documents of their own
and get the same spans. Spans that begin at one place are listed by kind. An empty table gives an empty result. A column named
pii_spans is replaced by ``annotate`` and kept by ``sanitise``. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import append_columns, cut, release, unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
WINDOW, CONTEXTS, GENERALISE, REMOVE = 6, 3, 0.6, 0.9
#: Disclosing pairs or texts with terms in one broadcast, terms that a task counts before it passes them on, bits of the largest filter.
BLOCK_ROWS, COUNTED, FILTER_BITS = 200_000, 200_000, 1 << 27

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        # the run before this sign is used up either way: a later address starts behind it
        done = max(done, at + 1)
        at = t.find("@", done)


def _ips(t: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(t):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def entities(t: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by start, then kind as listed."""
    out = []
    if "@" in t:
        out += [("email", s, e) for s, e in _emails(t)]
    if _DIGIT.search(t):
        out += [("ip", s, e) for s, e in _ips(t)]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in t:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _value(kind: str, raw: str) -> str:
    return f"{kind}:{raw.lower() if kind == 'email' else _digits(raw) if kind != 'ip' else raw}"


def _terms(t: str) -> set[str]:
    return {x.lower() for x in set(_TERM.findall(t))}


def _touched(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a base span touches the place from start to end."""
    starts, ends = [], []
    for _, s, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def touched(s: int, e: int) -> bool:
        i = bisect_right(ends, s)
        return i < len(ends) and starts[i] < e

    return touched


def _neighbours(t: str, spans: list, window: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Each entity's value with the terms among the ``window`` words on either side that no base span touches."""
    words = [(m.group().lower(), m.start(), m.end()) for m in _TERM.finditer(t)]
    starts, ends, touched = [x[1] for x in words], [x[2] for x in words], _touched(spans)
    for kind, s, e in spans:
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        near = words[max(0, before - window) : before] + words[after : after + window]
        yield _value(kind, t[s:e]), [x for x in near if not touched(x[1], x[2])]


def co_occurrence(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """entity, term, context: one row per document, entity and term near it; a row without a term stands for the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                t = t.as_py()
                if t and (spans := entities(t)):
                    seen = {}
                    for value, near in _neighbours(t, spans, window):
                        context = int.from_bytes(hashlib.blake2b("\0".join([value, *[x[0] for x in near]]).encode(), digest_size=8).digest(), "little", signed=True)
                        seen.setdefault((value, None), context)
                        for term, _, _ in near:
                            seen.setdefault((value, term), context)
                    rows += [(v, x, c) for (v, x), c in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["entity", "term", "context"])
        release()

    return docs.select("text").mapInArrow(run, "entity string, term string, context long")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, docs: in how many documents each term stands, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "docs"])

        for batch in batches:
            for t in batch.column("text"):
                for term in _terms(t.as_py() or ""):
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) >= COUNTED:
                    yield part()
                    counts.clear()
        yield part()
        counts.clear()
        release()

    return docs.select("text").mapInArrow(run, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def disclosing(docs: DataFrame, window: int = WINDOW, contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, share: the pairs whose term discloses the entity."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    near = co_occurrence(docs, window)
    by_context = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = cut(by_context.groupBy("entity", "term").agg(F.count("*").alias("k"), F.sum("n").alias("n")))
    n = docs.count()
    own = pairs.where(F.col("term").isNull()).select("entity", F.col("n").alias("of_entity"))
    joint = pairs.where(F.col("term").isNotNull()).join(own, "entity").join(term_frequencies(docs), "term")
    together = F.col("n") * F.col("k") / (F.col("k") + contexts)
    share = F.log((together / F.col("of_entity")) * (F.lit(n) / F.col("docs"))) / F.log(F.lit(n + 1) / F.col("of_entity"))
    return cut(joint.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise))


def _terms_of_texts(docs: DataFrame, pairs: DataFrame, remove: float) -> DataFrame:
    """pii_key, pii_spans: a text's hash and its disclosing terms as (term, share); other texts have no row.

    One pass over the documents, whatever the number of pairs: up to ``BLOCK_ROWS`` they are broadcast; beyond, a filter of bounded size is,
    and what passes it is joined with the pairs.
    """
    docs = docs.select(F.xxhash64("text").alias("key"), "text")
    found = _by_broadcast(docs, pairs, remove) if pairs.count() <= BLOCK_ROWS else _by_join(docs, pairs, remove)
    once = found.groupBy("key", "term").agg(F.max("share").alias("share"))
    return cut(once.groupBy(F.col("key").alias("pii_key")).agg(F.collect_list(F.struct("term", "share")).alias("pii_spans")))


def _by_broadcast(docs: DataFrame, pairs: DataFrame, remove: float) -> DataFrame:
    """key, term, share of the disclosing terms of every text."""
    by_term: dict[str, dict[str, float]] = {}
    for r in pairs.collect():
        by_term.setdefault(r["term"], {})[r["entity"]] = r["share"]
    shared = docs.sparkSession.sparkContext.broadcast(by_term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        top = {term: max(of.values()) for term, of in known.items()}
        for batch in batches:
            rows = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                t = t.as_py()
                if t and (found := known.keys() & _terms(t)):
                    held = {_value(kind, t[s:e]) for kind, s, e in entities(t)}
                    for term in found:
                        share = top[term] if top[term] >= remove else max((known[term][v] for v in held & known[term].keys()), default=None)
                        if share is not None:
                            rows.append((key, term, share))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["key", "term", "share"])
        release()

    return docs.mapInArrow(run, "key long, term string, share double")


def _code(entity: str, term: str) -> int:
    return zlib.crc32(term.encode(), zlib.crc32(entity.encode()))


def _filter(rules: DataFrame, bits: int) -> bytes:
    """A bitmap of the codes of (entity, term), made by the tasks and put together by words: at most bits / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([_code(*x) % bits for x in zip(batch.column("entity").to_pylist(), batch.column("term").to_pylist())], np.int64)
            word, at = np.unique(codes >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (codes & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    got = rules.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out.astype("<u8").tobytes()


def _by_join(docs: DataFrame, pairs: DataFrame, remove: float) -> DataFrame:
    """The same by a join; a rule without an entity holds in every text."""
    top = pairs.groupBy("term").agg(F.max("share").alias("top"))
    alone = top.where(F.col("top") >= remove).select(F.lit("").alias("entity"), "term", F.col("top").alias("share"))
    rules = cut(pairs.join(top.where(F.col("top") < remove), "term").select("entity", "term", "share").unionByName(alone))
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * rules.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(rules, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bits = shared.value
        for batch in batches:
            rows = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                t = t.as_py()
                if not t:
                    continue
                owners = {"": zlib.crc32(b"")} | {v: zlib.crc32(v.encode()) for v in (_value(kind, t[s:e]) for kind, s, e in entities(t))}
                for term in _terms(t):
                    raw = term.encode()
                    for owner, start in owners.items():
                        at = zlib.crc32(raw, start) % bits
                        if held_bits[at >> 3] >> (at & 7) & 1:
                            rows.append((key, term, owner))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["key", "term", "entity"])
        release()

    return docs.mapInArrow(run, "key long, term string, entity string").join(rules, ["entity", "term"]).select("key", "term", "share")


_ORDER = (*KINDS, "generalise", "remove")


def _spans(text: str, of: list[dict] | None, remove: float) -> list[tuple[str, int, int]]:
    """Base spans of a text, and those of its disclosing terms (term, share)."""
    spans = entities(text)
    if of:
        known, touched = {x["term"]: x["share"] for x in of}, _touched(spans)
        for m in _TERM.finditer(text):
            if (share := known.get(m.group().lower())) is not None and not touched(m.start(), m.end()):
                spans.append(("remove" if share >= remove else "generalise", m.start(), m.end()))
    return sorted(spans, key=lambda x: (x[1], _ORDER.index(x[0])))


def _told(docs: DataFrame, settings: dict) -> DataFrame:
    """``docs`` (text as a string) with the disclosing terms of every text as pii_spans."""
    given = {k: v for k, v in settings.items() if k != "remove"}
    terms = _terms_of_texts(docs, disclosing(docs, **given), settings.get("remove", REMOVE))
    few = F.broadcast(terms) if terms.count() <= BLOCK_ROWS else terms
    return docs.join(few, F.xxhash64(docs["text"]) == terms["pii_key"], "left").drop(terms["pii_key"])


def annotate(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with pii_spans: base spans of the four kinds, and ``generalise`` or ``remove`` spans of disclosing terms.

    Settings: window, contexts, generalise and remove.
    """
    told = _told(docs.drop("pii_spans").withColumn("text", F.col("text").cast("string")), settings)
    remove = settings.get("remove", REMOVE)

    def make():
        def each(batch: pa.RecordBatch) -> list:
            got = [_spans(t.as_py() or "", of, remove) for t, of in zip(batch.column("text"), batch.column("pii_spans").to_pylist())]
            return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in got], _SPAN_ARROW)]

        return each

    return append_columns(told, make, [T.StructField("pii_spans", SPAN)])


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become their class in brackets, generalised terms [TERM], removed terms nothing; overlapping spans count as the first."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], {"generalise": "[TERM]", "remove": ""}.get(kind, f"[{kind.upper()}]")]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """The documents with sanitised texts (and n_chars to match, where there is one); nulls stay null."""
    told, remove = _told(wrapped(docs), settings), settings.get("remove", REMOVE)

    def make():
        def each(batch: pa.RecordBatch) -> list:
            new = []
            for t, of in zip(batch.column("text"), batch.column("pii_spans").to_pylist()):
                t = t.as_py()
                new.append(redact(t, spans) if t and (spans := _spans(t, of, remove)) else t)
            return [pa.array(new, pa.string())]

        return each

    done = append_columns(told, make, [T.StructField("text", T.StringType())])
    kinds = dict(docs.dtypes)
    return unwrapped(done, docs).withColumns({"n_chars": F.length("text").cast(kinds["n_chars"])} if "n_chars" in kinds else {})
