"""Programs of the bar script language on ticks: developing bars that repaint, and closed bars that stay.

A symbol's state is the program after its last closed bar, and the bar that develops. Every tick runs the program on the developing bar from the
closed state, so nothing of an earlier tick remains but variables declared ``varip``; the close of the bar becomes the new state. A
closed bar's plots are therefore those of a batch run over the closed bars, for programs that do not ask for the bar's state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators import broker as B
from barframe.operators.timeframe import parse
from barframe.plans.clock import Chart, bucket
from barframe.plans.interp import Machine, settings
from barframe.plans.script import Script, titles

#: How many bars and values of the past a live program keeps.
KEPT = 5000


@dataclass
class Forming:
    """The bar that develops."""

    time: object
    open: float
    high: float
    low: float
    close: float
    volume: float
    ticks: int = 1

    def add(self, price: float, volume: float = 1.0) -> None:
        self.high, self.low, self.close = max(self.high, price), min(self.low, price), price
        self.volume, self.ticks = self.volume + volume, self.ticks + 1


class Live:
    """One symbol's program on ticks."""

    def __init__(self, script: Script, symbol: str):
        tree = script.tree
        account = B.Account(settings(tree)) if script.kind == "strategy" else None
        self.machine = Machine(tree, script.values, account, Chart(script.sources.timeframe), symbol)
        self.closed, self.bars = pickle.dumps(self.machine), 0

    def tick(self, forming: Forming, is_close: bool) -> dict:
        """The plots of the developing bar; on its close they stay."""
        machine: Machine = pickle.loads(self.closed)
        machine.chart = machine.chart.live(is_close, forming.ticks == 1)
        kept = {k: v for k, v in self.machine.persist.items() if k in self.machine.intrabar}
        machine.persist.update(kept)
        data = SimpleNamespace(open=forming.open, high=forming.high, low=forming.low, close=forming.close, volume=forming.volume, time=forming.time)
        bar = B.Bar(forming.open, forming.high, forming.low, forming.close, forming.time, self.bars, data)
        if machine.account is not None:
            machine.account.run_bar(bar, lambda _, b: machine.run_bar(b))
        else:
            machine.run_bar(bar)
        self.machine = machine
        if is_close:
            machine.trim(KEPT)
            self.closed, self.bars = pickle.dumps(machine), self.bars + 1
        return machine.plots

    def history(self, bars: pd.DataFrame) -> None:
        """Closed bars before the first tick."""
        for r in bars.sort_values("time", kind="stable").itertuples(index=False):
            self.tick(Forming(r.time, r.open, r.high, r.low, r.close, r.volume), True)


def script_stream(ticks: DataFrame, script: Script, every_tick: bool = True) -> DataFrame:
    """symbol, time, ticks, confirmed and the plots, from a stream of symbol, ts, price and tie (the order of ticks of one time).

    A bar closes with the first tick of a later period of its symbol. With ``every_tick`` the developing bar is told after
    every tick, ``confirmed`` false, and repaints; else only closed bars leave. Ticks of closed bars come too late and are left out.
    """
    names, tf = titles(script.tree), script.sources.timeframe
    schema = "symbol string, time timestamp_ntz, ticks long, confirmed boolean" + "".join(f", `{n}` double" for n in names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        live, forming = pickle.loads(state.get[0]) if state.exists else (Live(script_of(), key[0]), None)
        out: list[list] = []

        def told(bar: Forming, confirmed: bool) -> None:
            plots = live.tick(bar, confirmed)
            if confirmed or every_tick:
                out.append([key[0], bar.time, bar.ticks, confirmed, *[plots.get(n) for n in names]])

        for r in pd.concat(list(frames)).sort_values(["ts", "tie"], kind="stable").itertuples(index=False):
            t = pd.Timestamp(r.ts).tz_localize(None) if pd.Timestamp(r.ts).tzinfo is None else pd.Timestamp(r.ts).tz_convert("UTC").tz_localize(None)
            start = opening(t, tf)
            if forming is not None and start < forming.time:
                continue
            if forming is not None and start > forming.time:
                told(forming, True)
                forming = None
            if forming is None:
                forming = Forming(start, r.price, r.price, r.price, r.price, 1.0)
            else:
                forming.add(r.price)
            if every_tick:
                told(forming, False)
        state.update((pickle.dumps((live, forming)),))
        got = pd.DataFrame(out, columns=["symbol", "time", "ticks", "confirmed", *names])
        yield got.astype({n: "float64" for n in names})

    text_tree, values, kind, sources = script.tree, script.values, script.kind, replace(script.sources, universe=None, lower=None)

    def script_of() -> Script:
        bare = Script.__new__(Script)
        bare.tree, bare.values, bare.kind, bare.sources = text_tree, values, kind, sources
        return bare

    script = None  # the closure must not hold tables
    rows = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price"), F.col("tie").cast("long").alias("tie"))
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "state binary", "append", "NoTimeout")


def opening(t: pd.Timestamp, tf: str) -> pd.Timestamp:
    """When the period that holds a time begins, UTC."""
    p, n = parse(tf), bucket(t, tf)
    if p.unit == "M":
        months = n * p.multiplier
        return pd.Timestamp(year=months // 12, month=months % 12 + 1, day=1)
    days = 7 * p.multiplier * n - 3 if p.unit == "W" else p.multiplier * n
    return pd.Timestamp(0) + (pd.Timedelta(days=days) if p.unit in ("W", "D") else pd.Timedelta(seconds=n * p.seconds))
