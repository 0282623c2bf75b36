"""``request.security`` and ``request.security_lower_tf`` of programs, as columns made before a program runs.

Each request becomes a program of its own: the statements in front of it that its expression needs, and one plot for every value. It
runs on the requested bars by whichever backend it allows, and its plots are aligned with the chart's bars. Equal requests are made
once. Requests inside functions, loops or conditions have no bars of their own and are refused.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators import security as Q
from barframe.operators.timeframe import bucket
from barframe.plans.lang import ScriptError, dotted

_OWN = {"syminfo.tickerid", "syminfo.ticker", "syminfo.main_tickerid"}


@dataclass(frozen=True)
class Sources:
    """Where requests find bars: a program's own table, all symbols' tables, and finer bars."""

    timeframe: str = "60"
    universe: DataFrame | None = None
    lower: DataFrame | None = None


def _walk(x):
    """All nodes of a tree."""
    if isinstance(x, tuple) and x and isinstance(x[0], str):
        yield x
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from _walk(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from _walk(y)


def is_request(e) -> bool:
    return len(e) == 5 and e[0] == "call" and dotted(e[1]) in ("request.security", "request.security_lower_tf")


def _ids(x) -> set[str]:
    return {n[1].split(".")[0] for n in _walk(x) if n[0] == "id"} | {n[1] for n in _walk(x) if n[0] == "id"} | {d for n in _walk(x) if n[0] == "attr" and (d := dotted(n))}


def _writes(s) -> set[str]:
    """The names that a statement sets."""
    out: set[str] = set()
    for n in _walk(s):
        if n[0] in ("decl", "assign", "func", "type", "enum"):
            out.add(n[1])
        elif n[0] == "detup":
            out |= set(n[1])
        elif n[0] == "setattr":
            out |= _ids(n[1])
        elif n[0] == "call" and n[1][0] == "attr" and n[1][1][0] == "id":
            out.add(n[1][1][1])  # a method may change its object
    return out


def needed(before: list, expression) -> list:
    """The statements of ``before`` that an expression depends on."""
    names, kept = _ids(expression), []
    for s in reversed(before):
        if s[0] == "expr" and s[1][0] == "call" and dotted(s[1][1]) in ("indicator", "strategy"):
            continue
        if _writes(s) & names:
            kept.append(s)
            names |= _ids(s)
    return kept[::-1]


def _plain(x):
    """A tree without its site numbers, to tell equal requests."""
    if isinstance(x, tuple):
        body = x[:-1] if x and (x[0], len(x)) in (("call", 5), ("back", 4)) else x
        return tuple(_plain(y) for y in body)
    if isinstance(x, list):
        return tuple(_plain(y) for y in x)
    return tuple(sorted((k, _plain(v)) for k, v in x.items())) if isinstance(x, dict) else x


class Requests:
    """Replaces the requests of a program by columns that it adds to a bar table."""

    def __init__(self, tree: list, values: dict, sources: Sources, run):
        self.tree, self.values, self.sources, self.run = tree, values, sources, run
        self.made: dict = {}

    def literal(self, e, before: list):
        """A text or truth value that does not change from bar to bar."""
        if e is None or e[0] == "na":
            return None
        if e[0] in ("str", "bool", "num"):
            return e[1]
        name = dotted(e)
        if name == "timeframe.period":
            return self.sources.timeframe
        if name in ("barmerge.gaps_on", "barmerge.lookahead_on"):
            return True
        if name in ("barmerge.gaps_off", "barmerge.lookahead_off"):
            return False
        if name in _OWN:
            return ""
        if e[0] == "call" and (dotted(e[1]) or "").split(".")[0] == "input":
            title = e[3].get("title") or (e[2][1] if len(e[2]) > 1 else None)
            given = self.values.get(title[1]) if title else None
            return given if given is not None else self.literal(e[3].get("defval") or e[2][0], before)
        if e[0] == "id":
            for s in reversed(before):
                if s[0] == "decl" and s[1] == e[1] and not s[3]:
                    return self.literal(s[2], before)
        raise ScriptError("a request's symbol, timeframe and modes are literal")

    def apply(self, bars: DataFrame) -> tuple[DataFrame, list]:
        """The bars with the requests' columns, and the program that reads them."""
        out = []
        for at, s in enumerate(self.tree):
            if s[0] == "func" and any(is_request(n) for n in _walk(s[3])):
                raise ScriptError("a request inside a function")
            bars, s = self._replace(bars, s, self.tree[:at], s[0] in ("expr", "decl", "detup", "assign"))
            out.append(s)
        return bars, out

    def _replace(self, bars: DataFrame, x, before: list, top: bool):
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            if is_request(x):
                if not top:
                    raise ScriptError("a request inside a loop or condition")
                return self._request(bars, x, before)
            if x[0] in ("if", "switch", "for", "forin", "while"):
                top = False
        if isinstance(x, (list, tuple)):
            parts = []
            for y in x:
                bars, y = self._replace(bars, y, before, top)
                parts.append(y)
            return bars, type(x)(parts)
        if isinstance(x, dict):
            done = {}
            for k, y in x.items():
                bars, done[k] = self._replace(bars, y, before, top)
            return bars, done
        return bars, x

    def _request(self, bars: DataFrame, e, before: list):
        _, f, args, named, site = e
        fine = dotted(f) == "request.security_lower_tf"
        given = dict(zip(("symbol", "timeframe", "expression") if fine else ("symbol", "timeframe", "expression", "gaps", "lookahead"), args)) | named
        symbol, tf = self.literal(given["symbol"], before) or "", self.literal(given["timeframe"], before) or self.sources.timeframe
        gaps, ahead = bool(self.literal(given.get("gaps"), before)), bool(self.literal(given.get("lookahead"), before))
        expression = given["expression"]
        many = expression[0] == "tuple"
        parts = expression[1] if many else [expression]
        program = needed(before, expression)
        key = (fine, symbol, tf, gaps, ahead, _plain(expression), _plain(program))
        if key not in self.made:
            names = tuple(f"req{len(self.made)}_{i}" for i in range(len(parts)))
            plots = [("expr", ("call", ("id", "plot"), [p, ("str", n)], {}, site + i + 1)) for i, (p, n) in enumerate(zip(parts, names))]
            bars = self._aligned(bars, [*program, *plots], list(names), symbol, tf, gaps, ahead, fine)
            self.made[key] = names
        return bars, ("column", self.made[key], many)

    def _aligned(self, bars: DataFrame, program: list, names: list[str], symbol: str, tf: str, gaps: bool, ahead: bool, fine: bool) -> DataFrame:
        chart = self.sources.timeframe

        def on(table: DataFrame, timeframe: str) -> DataFrame:
            return self.run(program, table, Sources(timeframe, self.sources.universe, self.sources.lower))

        if fine:
            if self.sources.lower is None:
                raise ScriptError("a request of finer bars needs a table of them")
            got = on(self.sources.lower, tf).where(functools.reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
            return Q.lower_timeframe(bars, got, {n: F.col(n) for n in names})
        expr = lambda higher: on(higher.drop("bucket"), tf).withColumn("bucket", bucket("time", tf))
        if not symbol:
            return Q.security(bars, tf, expr, names, chart, ahead, gaps)
        every = self.sources.universe if self.sources.universe is not None else bars
        plain = symbol.rpartition(":")[2]
        other = every.where(F.col("symbol").isin(symbol, plain)).select("symbol", "time", "open", "high", "low", "close", "volume")
        return Q.cross_symbol(bars, other, tf, expr, names, chart, ahead)
