"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The index
posts, for each trigram of the queries, the documents whose lower-cased text holds it; intersecting and uniting the
postings by document gives each rule's candidates, and only these are searched with the expression. Rules without
mandatory trigrams scan every document. Candidates are broadcast behind a check of their count, else joined.

Spans count code points, ends exclusive; matches are leftmost and do not overlap within a rule, and a match that fails the
rule's length test is dropped without a retry. A null or empty text has no match; very long texts are searched whole. Repeated rows are searched
one by one. Spans that begin at one place are listed by rule. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads the same in Python and Java; ``least`` is the least length of group ``group``."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    prefilter: str | None = None


# The base rules, with runs that must fail their length test kept as matches where that matters.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
# Public token formats that the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Candidates in one broadcast; strings and members of a class that a query spells out.
BROADCAST_ROWS, SPELL, CLASS = 200_000, 48, 6

Query = frozenset | bool  # a set of alternatives, each a frozenset of trigrams; True: every document


class Reader:
    """The part of regular expressions that rules use, as sequences of nodes.

    ("chars", members or None if they are many), ("either", sequences), ("repeat", least, most, sequence); what has no width is left out.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.text[self.at - n : self.at]

    def alternatives(self) -> list[list]:
        out = [self.sequence()]
        while self.peek() == "|":
            self.take()
            out.append(self.sequence())
        return out

    def sequence(self) -> list:
        out: list = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            low, high = self.times()
            if node is not None:
                out.append(node if (low, high) == (1, 1) else ("repeat", low, high, [node]))
        return out

    def atom(self):
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return ("chars", self.members())
        if c == "\\":
            return self.escape()
        return None if c in "^$" else ("chars", None if c == "." else frozenset(c))

    def group(self):
        around = False
        if self.peek() == "?":
            self.take()
            head = next((h for h in ("i:", ":", "<!", "<=", "!", "=") if self.text.startswith(h, self.at)), None)
            if head is None:
                raise ValueError(f"a group that rules do not use: {self.text[self.at - 2 :][:8]}")
            self.take(len(head))
            around = head in ("<!", "<=", "!", "=")
        parts = self.alternatives()
        self.take()
        return None if around else ("either", parts)

    def escape(self):
        c = self.take()
        if c == "x":
            return ("chars", frozenset(chr(int(self.take(2), 16))))
        if c in "bB":
            return None
        return ("chars", None if c in "dDwWsS" else frozenset(c))

    def members(self) -> frozenset | None:
        many = self.peek() == "^"
        found: set[str] = set()
        first = True
        while first or self.peek() != "]":
            first, c = False, self.take()
            one = self.escape()[1] if c == "\\" else frozenset(c)
            if one is None:
                many = True
                continue
            (low,) = one
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                found |= {chr(x) for x in range(ord(low), ord(self.take()) + 1)}
            else:
                found.add(low)
        self.take()
        return None if many else frozenset(found)

    def times(self) -> tuple[int, float]:
        c, low, high = self.peek(), 1, 1.0
        if c and c in "*+?":
            self.take()
            low, high = {"*": (0, float("inf")), "+": (1, float("inf")), "?": (0, 1)}[c]
        elif c == "{":
            first, comma, last = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            self.at = self.text.index("}", self.at) + 1
            low = int(first or 0)
            high = low if not comma else int(last) if last else float("inf")
        else:
            return 1, 1
        if self.peek() in ("?", "+") and self.peek():
            self.take()
        return low, high


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, one of which stands whole in the lower-cased text of every match; True if there are none."""
    return _query([("either", Reader(pattern).alternatives())])


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    both = _least(x | y for x in a for y in b)
    return both if len(both) <= SPELL else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else _least(a | b)


def _least(alternatives) -> frozenset:
    """Without the alternatives that ask for more than another."""
    some = set(alternatives)
    return frozenset(x for x in some if not any(y < x for y in some))


def _of(strings: set[str]) -> Query:
    out = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return True if not all(out) else _least(out)


def _spelled(sequence: list) -> set[str] | None:
    """The strings that a sequence can match, lower-cased, if they are few."""
    now = {""}
    for node in sequence:
        if node[0] == "chars":
            step = None if node[1] is None or len(node[1]) > CLASS else {c.lower() for c in node[1]}
        elif node[0] == "either":
            parts = [_spelled(x) for x in node[1]]
            step = None if None in parts else set().union(*parts)
        else:
            one = _spelled(node[3]) if node[2] <= 5 else None
            step = None if one is None else {"".join(p) for k in range(node[1], node[2] + 1) for p in _power(one, k)}
        if step is None:
            return None
        now = {a + b for a in now for b in step}
        if len(now) > SPELL:
            return None
    return now


def _power(strings: set[str], k: int) -> list[tuple]:
    out: list[tuple] = [()]
    for _ in range(k):
        out = [(*p, s) for p in out for s in strings]
        if len(out) > SPELL:
            return out
    return out


def _query(sequence: list) -> Query:
    query: Query = True
    run = {""}
    for node in sequence:
        one = _spelled([node])
        if one is not None:
            longer = {a + b for a in run for b in one}
            if len(longer) <= SPELL:
                run = longer
                continue
        query, run = _both(query, _of(run)), {""}
        if one is not None:
            run = one
            continue
        if node[0] == "either":
            part: Query = frozenset()
            for x in node[1]:
                part = _either(part, _query(x))
            query = _both(query, part)
        elif node[0] == "repeat" and node[1] >= 1:
            query = _both(query, _query(node[3]))
    return _both(query, _of(run))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules if (q := trigram_query(r.pattern)) is not True for alternative in q for g in alternative})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules: the numbers of the rules whose query the document's postings satisfy."""
    terms = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    tests = []
    for n, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is not True:
            any_of = None
            for alternative in sorted(query, key=sorted):
                needed = F.array(*[F.lit(g) for g in sorted(alternative)])
                one = F.size(F.array_except(needed, "held")) == 0
                any_of = one if any_of is None else any_of | one
            tests.append(F.when(any_of, F.lit(n)))
    return terms.select("doc_id", F.array_compact(F.array(*tests)).alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of a rule's matches, located by the lengths of the pieces between them."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(rule.name).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        kept = F.coalesce(F.length(x["value"]) >= rule.least, F.lit(False))
        return F.struct(end.cast("bigint").alias("at"), F.when(kept, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and secret_spans, by start and then by the rules' order."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = cut(candidates(build_index(docs, rules), rules).withColumnRenamed("doc_id", "candidate"))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    marked = docs.join(found, F.col("doc_id").eqNullSafe(F.col("candidate")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    parts = []
    for n, rule in enumerate(rules):
        if trigram_query(rule.pattern) is True:
            asked = F.col("text").rlike(rule.prefilter or rule.pattern)
        else:
            asked = F.coalesce(F.array_contains("rules", n), F.lit(False))
        parts.append(F.when(asked, matches(F.col("text"), rule)).otherwise(none))
    rank = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.name), F.lit(n))])
    keyed = F.array_sort(F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return marked.select("doc_id", spans.alias("secret_spans"))

