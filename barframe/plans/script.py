"""Programs of the bar script language on bar tables.

A program whose values need no state of their own is lowered to columns, window functions and fused recursive kernels; any
other runs in one grouped kernel per symbol. ``Script.plan`` says which, and why.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe import na as N
from barframe.functions import scalar as S
from barframe.operators import broker as B
from barframe.operators import recursive as R
from barframe.operators import ta
from barframe.operators import drawings as D
from barframe.operators import timeframe as T
from barframe.plans.clock import chart_of
from barframe.plans.interp import NOT_SERVED, Machine, settings
from barframe.plans.lang import ScriptError, dotted, header, inputs, parse
from barframe.plans.modules import Loader, resolve
from barframe.plans.requests import Requests, Sources

_SERIES = {"open", "high", "low", "close", "volume", "time"}
_DERIVED = {"hl2": ta.hl2, "hlc3": ta.hlc3, "ohlc4": ta.ohlc4, "hlcc4": ta.hlcc4, "bar_index": ta.KEYS.index}
_MATH = {"abs": F.abs, "max": S.max_of, "min": S.min_of, "avg": S.avg_of, "sqrt": S.sqrt, "pow": S.power, "round": S.round_half_away, "floor": S.floor, "ceil": S.ceil, "sign": S.sign, "log": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan}
#: Indicators as columns: those in the first set take a column and literals, crosses take two columns.
_TA = {"sma", "stdev", "variance", "median", "wma", "alma", "hma", "dev", "cci", "cog", "linreg", "vwma", "bbw", "cmo", "mfi", "rci", "mode", "highest", "lowest", "highestbars", "lowestbars", "percentrank", "swma", "rising", "falling", "change", "mom", "roc", "cum", "barssince", "pivothigh", "pivotlow"}
_PAIRS = {"cross": ta.cross, "crossover": ta.crossover, "crossunder": ta.crossunder}


_DATES = ("year", "month", "weekofyear", "dayofmonth", "dayofweek", "hour", "minute", "second")


class NotColumnar(Exception):
    """Why a program needs the sequential kernel."""


class Lowering:
    """Builds the columnar plan of a program."""

    def __init__(self, df: DataFrame, functions: dict, values: dict, timeframe: str = "60"):
        self.df, self.functions, self.values, self.timeframe = df, functions, values, timeframe
        self.env: dict = {}
        self.plots: dict[str, Column] = {}
        self.calls: list[R.Call] = []
        self.alerts: list[tuple[Column, str]] = []
        self.made = 0
        self.depth = 0

    def keep(self, x):
        """A column that later windows may use: named in the table."""
        if not isinstance(x, Column):
            return x
        self.ready(x)
        self.made += 1
        name = f"_x{self.made}"
        self.df = self.df.withColumn(name, x)
        return F.col(name)

    def ready(self, x: Column | None = None) -> None:
        """Runs the recursive kernels that wait, all in one pass: those that ``x`` reads, or whatever there are."""
        waiting = {n for c in self.calls for n in c.out}
        if waiting and (x is None or waiting & set(re.findall(r"_x\d+", repr(x)))):
            self.df, self.calls = R.with_recursive(self.df, self.calls), []

    def done(self) -> DataFrame:
        """The table with everything that the plots read."""
        self.ready()
        return self.df

    def literal(self, e):
        x = self.eval(e)
        if isinstance(x, Column):
            raise NotColumnar("a length or offset that is not literal")
        return x

    def run(self, tree: list) -> None:
        for s in tree:
            self.statement(s)

    def statement(self, s) -> object:
        kind = s[0]
        if kind in ("func", "type", "enum"):
            return None
        if kind == "decl" and not s[3]:
            self.env[s[1]] = self.keep(self.eval(s[2]))
            return self.env[s[1]]
        if kind == "assign" and s[1] in self.env:
            self.env[s[1]] = self.keep(self.eval(s[2]))
            return self.env[s[1]]
        if kind == "detup":
            got = self.eval(s[2])
            if not isinstance(got, list):
                raise NotColumnar("a tuple of unknown shape")
            self.env |= dict(zip(s[1], got))
            return got
        if kind == "expr":
            return self.eval(s[1])
        raise NotColumnar(f"a statement of kind {kind}" + (" with memory" if kind == "decl" else ""))

    def eval(self, e):
        kind = e[0]
        if kind in ("num", "str", "bool"):
            return e[1]
        if kind == "na":
            return F.lit(None).cast("double")
        if kind == "id":
            if e[1] in self.env:
                return self.env[e[1]]
            if e[1] in _SERIES:
                return F.col(e[1])
            if e[1] in _DERIVED:
                return _DERIVED[e[1]]()
            if e[1] in _DATES:
                return S.date_parts("time")[e[1]].cast("double")
            if e[1] == "time_close":
                return T.time_close(self.timeframe)
            raise NotColumnar(f"the name {e[1]}")
        if kind == "attr":
            name = dotted(e) or ""
            if name == "ta.tr":
                return ta.tr()
            if name.startswith("ta.") and name[3:] in ("obv", "accdist", "wad", "nvi", "pvi", "pvt"):
                return getattr(ta, name[3:])()
            if name.startswith("color.") and name[6:] in S.COLORS:
                return S.COLORS[name[6:]]
            if name.startswith("math."):
                return {"math.pi": S.PI, "math.e": S.E, "math.phi": S.PHI, "math.rphi": S.RPHI}[name]
            if name.startswith("timeframe.") and name[10:] in T.flags(self.timeframe):
                return T.flags(self.timeframe)[name[10:]]
            raise NotColumnar(f"the name {name}")
        if kind == "column":
            got = [F.col(n) for n in e[1]]
            return got if e[2] else got[0]
        if kind == "un":
            x = self.eval(e[2])
            return N.not_(x) if e[1] == "not" else -x if e[1] == "-" else x
        if kind == "bin":
            return self.binary(e[1], self.eval(e[2]), self.eval(e[3]))
        if kind == "tern":
            c, a, b = (self.eval(x) for x in e[1:])
            return F.when(N.truthy(c), N.col(a) if not isinstance(a, str) else F.lit(a)).otherwise(N.col(b) if not isinstance(b, str) else F.lit(b))
        if kind == "back":
            n = self.literal(e[2])
            return ta.KEYS.lag(N.col(self.keep(self.eval(e[1]))), int(n)) if n else self.eval(e[1])
        if kind == "if" and e[2] is not None and all(len(b) == 1 and b[0][0] == "expr" for _, b in [*e[1], (None, e[2])]):
            out = N.col(self.eval(e[2][0][1]))
            for cond, body in reversed(e[1]):
                out = F.when(N.truthy(self.eval(cond)), N.col(self.eval(body[0][1]))).otherwise(out)
            return out
        if kind == "call":
            return self.call(e)
        raise NotColumnar(f"an expression of kind {kind}")

    def binary(self, op: str, a, b):
        if not isinstance(a, Column) and not isinstance(b, Column) and op in "+-*":
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
        if op == "+" and (isinstance(a, str) or isinstance(b, str)):
            raise NotColumnar("joined text")
        x, y = (N.col(v) if not isinstance(v, (int, float)) else F.lit(float(v)) for v in (a, b))
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: N.div(x, y), "%": lambda: N.mod(x, y), "and": lambda: N.and_(x, y), "or": lambda: N.or_(x, y), "<": lambda: N.lt(x, y), ">": lambda: N.gt(x, y), "<=": lambda: N.le(x, y), ">=": lambda: N.ge(x, y), "==": lambda: N.eq(x, y), "!=": lambda: N.ne(x, y)}[op]()

    def call(self, e):
        _, f, args, named, site = e
        name = dotted(f) or ""
        if name in ("indicator", "max_bars_back"):
            return None
        if name.split(".")[0] == "input":
            title = named.get("title") or (args[1] if len(args) > 1 else (None, None))
            given = self.values.get(title[1])
            if name == "input.source" and isinstance(given, str):
                return self.eval(("id", given))
            return self.eval(named.get("defval") or args[0]) if given is None else given
        if name in self.functions:
            return self.inline(self.functions[name], args, named)
        space, _, member = name.partition(".")
        if name == "plot" or name == "plotshape":
            title = named["title"][1] if "title" in named else args[1][1] if len(args) > 1 and args[1][0] == "str" else f"plot {site}"
            self.plots[title] = N.clean(N.col(self.eval(args[0])).cast("double"))
            return None
        if name == "alertcondition":
            message = named.get("message") or (args[2] if len(args) > 2 else args[1] if len(args) > 1 else ("str", ""))
            self.alerts.append((N.truthy(self.eval(args[0])), message[1]))
            return None
        if name in ("na", "nz", "fixnan"):
            x = N.col(self.eval(args[0]))
            return N.is_na(x) if name == "na" else ta.fixnan(self.keep(x)) if name == "fixnan" else N.nz(x, self.eval(args[1]) if len(args) > 1 else 0.0)
        if space == "math" and member in _MATH:
            values = [self.eval(a) for a in args]
            return _MATH[member](*[v if member in ("round", "pow") and i else N.col(v) for i, v in enumerate(values)])
        if space == "ta":
            return self.indicator(member, args)
        if name in _DATES and len(args) == 1:
            return S.date_parts(N.col(self.eval(args[0])))[name].cast("double")
        if name == "timeframe.change":
            return T.change(self.literal(args[0]))
        if name == "timeframe.in_seconds":
            return T.in_seconds(self.literal(args[0]) if args else self.timeframe)
        if space == "request" and member in NOT_SERVED:
            return F.lit(None).cast("double")
        raise NotColumnar(f"a call of {name}")

    def indicator(self, member: str, args: list):
        if member in _PAIRS:
            return _PAIRS[member](*[N.col(self.keep(self.eval(a))) for a in args])
        if member == "tr":
            return ta.tr(bool(self.literal(args[0])) if args else False)
        if member in ("atr", "ema", "rma", "rsi", "macd", "tsi", "kc", "kcw", "supertrend", "dmi", "sar"):
            _, fixed, outs, sourced = R.KERNELS[member]
            params = tuple(self.literal(a) for a in args[sourced:])
            source = None
            if sourced:
                x = N.col(self.eval(args[0])).cast("double")
                self.ready(x)
                self.made += 1
                source = f"_x{self.made}"
                self.df = self.df.withColumn(source, x)
            self.made += outs
            names = tuple(f"_x{self.made - i}" for i in range(outs))
            self.calls.append(R.Call(names, member, params, source))
            return [F.col(n) for n in names] if outs > 1 else F.col(names[0])
        if member == "bb":
            got = self.keep(ta.bb(self.keep(self.eval(args[0])), self.literal(args[1]), self.literal(args[2])))
            return [got["basis"], got["upper"], got["lower"]]
        if member in ("pivothigh", "pivotlow", "highest", "lowest", "highestbars", "lowestbars") and len(args) == (2 if "pivot" in member else 1):
            return getattr(ta, member)("high" if "high" in member else "low", *[self.literal(a) for a in args])
        if member in _TA or member in ("sum", "range", "max", "min"):
            f = getattr(ta, member if member in _TA else member + "_")
            return f(N.col(self.keep(self.eval(args[0]))), *[self.literal(a) for a in args[1:]])
        raise NotColumnar(f"a call of ta.{member}")

    def inline(self, f, args: list, named: dict):
        """A function's body in place of its call; each use has its own windows."""
        self.depth += 1
        if self.depth > 32:
            raise ScriptError("functions may not call themselves")
        given = [self.eval(a) for a in args]
        scope = {p: given[i] if i < len(given) else self.eval(named[p]) if p in named else self.eval(d) for i, (p, d) in enumerate(f[2])}
        held, self.env = self.env, self.env | scope
        value = None
        for s in f[3]:
            value = self.statement(s)
        self.env = held
        self.depth -= 1
        return value


def _kernel(tree: list, values: dict, timeframe: str, rows: pd.DataFrame, account: B.Account | None = None, each=None) -> Machine:
    """Runs a program over one symbol's bars; ``each`` sees the machine after every bar."""
    rows = rows.sort_values("time", kind="stable")
    machine = Machine(tree, values, account, chart_of(rows, timeframe), str(rows["symbol"].iloc[0]))
    for bar in B._bars(rows):
        if account is not None:
            lower = getattr(bar.data, "lower", None)
            finer = None if lower is None or not len(lower) else [B.Bar(x["open"], x["high"], x["low"], x["close"]) for x in lower]
            account.run_bar(bar, lambda _, b: machine.run_bar(b), finer)
        else:
            machine.run_bar(bar)
        if each:
            each(machine)
    return machine


class Script:
    """A parsed program with the values of its inputs by title.

    ``libraries`` finds the texts of imports. ``timeframe`` is the chart's; requests of other symbols look in ``universe`` (the chart's own
    table if there is none), those of finer bars in ``lower``.
    """

    def __init__(self, text: str, libraries: Loader | None = None, timeframe: str = "60", universe: DataFrame | None = None, lower: DataFrame | None = None, **values):
        own = parse(text)
        self.kind = header(own)[0]
        self.inputs = inputs(own)
        self.tree, self.values = resolve(own, libraries), values
        self.sources = Sources(timeframe, universe, lower)

    @property
    def functions(self) -> dict:
        return {s[1]: s for s in self.tree if s[0] == "func"}

    def _served(self, bars: DataFrame) -> tuple[DataFrame, list]:
        """The bars with what the program requests, and the program without requests."""
        return Requests(self.tree, self.values, self.sources, lambda tree, table, sources: _run(tree, self.values, table, sources)).apply(bars)

    def lowered(self, bars: DataFrame) -> Lowering:
        bars, tree = self._served(bars)
        return _lowered(tree, self.values, bars, self.sources, self.kind)

    def plan(self, bars: DataFrame) -> str:
        """``columns``, or ``kernel`` with the reason."""
        try:
            self.lowered(bars)
            return "columns"
        except NotColumnar as why:
            return f"kernel: {why}"

    def titles(self) -> list[str]:
        return titles(self.tree)

    def run(self, bars: DataFrame, columnar: bool = True) -> DataFrame:
        """symbol, time and one column per plot, NULL for na."""
        return _run(self.tree, self.values, bars, self.sources, self.kind, columnar)

    def _collected(self, bars: DataFrame, rows_of, schema: str) -> DataFrame:
        """One pass over each symbol; ``rows_of`` makes the rows of a machine that has run."""
        bars, tree = self._served(bars)
        values, tf = self.values, self.sources.timeframe
        config = settings(self.tree) if self.kind == "strategy" else None
        names = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema)]

        def kernel(rows: pd.DataFrame) -> pd.DataFrame:
            machine = _kernel(tree, values, tf, rows, B.Account(config) if config else None)
            return pd.DataFrame(rows_of(machine, str(rows["symbol"].iloc[0])), columns=names)

        return bars.groupBy("symbol").applyInPandas(kernel, schema)

    def alerts(self, bars: DataFrame) -> DataFrame:
        """symbol, bar_index, message of every alert."""
        return self._collected(bars, lambda m, s: [(s, *a) for a in m.alerts], "symbol string, bar_index long, message string")

    def outputs(self, bars: DataFrame) -> DataFrame:
        """symbol, bar_index, kind, title, props of candles, markers, colours, fills and levels."""
        return self._collected(bars, lambda m, s: [(s, *o) for o in m.outputs], "symbol string, bar_index long, kind string, title string, props map<string,string>")

    def drawings(self, bars: DataFrame) -> DataFrame:
        """The events of the program's drawings, as ``drawings.final_state`` reads them."""
        return self._collected(bars, lambda m, s: m.log.rows, D.EVENTS)

    def reads(self, bars: DataFrame, names: list[str] | None = None) -> DataFrame:
        """symbol and one column per statistic of a strategy's account after the last bar, as text."""
        wanted = names or list(B.READS)
        schema = "symbol string, " + ", ".join(f"`{n}` string" for n in wanted)
        text = lambda x: None if x is None else x if isinstance(x, str) else repr(float(x))
        return self._collected(bars, lambda m, s: [(s, *[text(m.account.read(n)) for n in wanted])], schema.replace("`", "")) if not any("." in n for n in wanted) else self._reads(bars, wanted, text)

    def _reads(self, bars: DataFrame, wanted: list[str], text) -> DataFrame:
        got = self._collected(bars, lambda m, s: [(s, {n: text(m.account.read(n)) for n in wanted})], "symbol string, props map<string,string>")
        return got.select("symbol", *[F.col("props")[n].alias(n) for n in wanted])

    def backtest(self, bars: DataFrame, **over) -> DataFrame:
        """The trade ledger of a strategy."""
        bars, tree = self._served(bars)
        values, config, tf = self.values, settings(self.tree, **over), self.sources.timeframe

        def kernel(rows: pd.DataFrame) -> pd.DataFrame:
            account = B.Account(config)
            _kernel(tree, values, tf, rows, account)
            out = pd.DataFrame(account.ledger, columns=[c.split()[0] for c in B.LEDGER.split(", ")][1:])
            out.insert(0, "symbol", rows["symbol"].iloc[0])
            return out

        return bars.groupBy("symbol").applyInPandas(kernel, B.LEDGER)


def titles(tree: list) -> list[str]:
    """The plots' titles in the order of the text."""
    out: list[str] = []

    def walk(x) -> None:
        if isinstance(x, (list, tuple)):
            if len(x) == 5 and x[0] == "call" and dotted(x[1]) in ("plot", "plotshape", "plotchar", "plotarrow"):
                title = x[3]["title"][1] if "title" in x[3] else x[2][1][1] if len(x[2]) > 1 and x[2][1][0] == "str" else f"plot {x[4]}"
                out.extend([title] if title not in out else [])
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            for y in x.values():
                walk(y)

    walk(tree)
    return out


def _lowered(tree: list, values: dict, bars: DataFrame, sources: Sources, kind: str) -> Lowering:
    if kind != "indicator":
        raise NotColumnar("a strategy")
    plan = Lowering(bars, {s[1]: s for s in tree if s[0] == "func"}, values, sources.timeframe)
    plan.run(tree)
    return plan


def _run(tree: list, values: dict, bars: DataFrame, sources: Sources, kind: str = "indicator", columnar: bool = True) -> DataFrame:
    """symbol, time and the plots of a program, its requests served first."""
    bars, tree = Requests(tree, values, sources, lambda t, b, s: _run(t, values, b, s, columnar=columnar)).apply(bars)
    if columnar:
        try:
            plan = _lowered(tree, values, bars, sources, kind)
            return plan.done().select("symbol", "time", *[c.alias(t) for t, c in plan.plots.items()])
        except NotColumnar:
            pass
    names, tf = titles(tree), sources.timeframe
    config = settings(tree) if kind == "strategy" else None

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        rows = rows.sort_values("time", kind="stable")
        _kernel(tree, values, tf, rows, B.Account(config) if config else None, lambda m: out.append([m.plots.get(t) for t in names]))
        got = pd.DataFrame(out, columns=names, dtype="float64")
        return pd.concat([rows[["symbol", "time"]].reset_index(drop=True), got], axis=1)

    schema = "symbol string, time timestamp_ntz" + "".join(f", `{t}` double" for t in names)
    return bars.groupBy("symbol").applyInPandas(kernel, schema)
