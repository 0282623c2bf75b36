"""The script language: reading, both backends against each other, strategies against the set-at-a-time backtest."""

import math

import pytest
from pyspark.sql import functions as F

from barframe.operators import signals as G
from barframe.operators import ta
from barframe.plans.lang import ScriptError, header, inputs, parse, tokenize
from barframe.plans.script import Script
from barframe.sources.bars import event_bars

SF = "/root/testdata/sf0.001"

COLUMNAR = """
//@version=6
indicator("columns")
n = input.int(5, "Length", minval=1)
spread(a, k = 3) =>
    m = ta.sma(a, k)
    a - m
fast = ta.ema(close, n)
[line, sig, hist] = ta.macd(close, 3, 6, 4)
[up, mid, low3] = ta.bb(close, 5, 2.0)
plot(spread(close) + spread(open, 4), "spread")
plot(fast[1] - fast, "step")
plot(hist, title="hist")
plot(up, "basis")
plot(close > open and not (close[1] > open[1]) ? high : low, "pick")
plot(ta.rsi(close, 4), "rsi")
plot(ta.highest(3), "hi")
plot(ta.barssince(ta.crossover(close, ta.sma(close, 3))), "since")
plot(nz(ta.change(close, 2), -1) / (volume - 1), "quot")
plot(math.max(open, close, hl2) % 7, "mod")
plot(ta.wma(close, 4), "wma")
plot(ta.linreg(close, 5, 1), "lin")
plot(ta.stdev(close, 4), "sd")
plot(ta.atr(4), "atr")
"""

SEQUENTIAL = """
indicator("memory")
type Box
    float top = 0
    int n = 0
enum Way
    up = "U"
    down
method grow(Box b, float x) =>
    b.top := math.max(b.top, x)
    b.n += 1
    b.top
var float total = 0.0
var Box box = Box.new(n = 3)
var int streak = 0
var array<float> seen = array.new<float>(0)
var memo = map.new<string, float>()
if close > open
    total += close
    streak := streak + 1
else if close < open
    streak := 0
else
    total := total
seen.push(close)
if seen.size() > 4
    seen.shift()
sum = 0.0
for i = 0 to seen.size() - 1
    if i == 2
        continue
    sum += seen.get(i)
for [i, v] in seen
    sum += i
k = 0
while true
    k += 1
    if k >= 5
        break
way = close > open ? Way.up : Way.down
code = switch way
    Way.up => 1
    Way.down => -1
    => 0
memo.put("last", close)
plot(total, "total")
plot(streak[1], "streak")
plot(sum, "sum")
plot(k, "k")
plot(code, "code")
plot(box.grow(high), "top")
plot(box.n, "n")
plot(memo.get("last"), "memo")
plot(seen.avg(), "avg")
alertcondition(close > open, "up", "rose")
"""

STRATEGY = """
strategy("cross", initial_capital=1000000, pyramiding=1)
f = ta.sma(close, 5)
s = ta.sma(close, 20)
if ta.crossover(f, s)
    strategy.entry("long", strategy.long, qty=1)
if ta.crossunder(f, s)
    strategy.close("long")
plot(strategy.position_size, "size")
"""


def rows(df):
    return {(r["symbol"], r["time"]): r.asDict() for r in df.collect()}


def test_backends_agree(spark):
    bars = event_bars(spark, SF).cache()
    script = Script(COLUMNAR, Length=6)
    assert script.plan(bars) == "columns"
    a, b = rows(script.run(bars)), rows(script.run(bars, columnar=False))
    assert a.keys() == b.keys() and len(a) > 800
    for key, want in b.items():
        for name, y in want.items():
            x = a[key][name]
            assert (x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7)), (key, name, x, y)


def test_sequential_program(spark):
    bars = event_bars(spark, SF)
    script = Script(SEQUENTIAL)
    assert script.plan(bars).startswith("kernel")
    got = {}
    for r in sorted(script.run(bars).collect(), key=lambda r: (r["symbol"], r["time"])):
        got.setdefault(r["symbol"], []).append(r)
    source = {}
    for r in sorted(bars.collect(), key=lambda r: (r["symbol"], r["time"])):
        source.setdefault(r["symbol"], []).append(r)
    for symbol, bs in source.items():
        total = streak = top = 0.0
        seen, before = [], None
        for i, (b, g) in enumerate(zip(bs, got[symbol])):
            if b["close"] > b["open"]:
                total, streak = total + b["close"], streak + 1
            elif b["close"] < b["open"]:
                streak = 0
            seen = (seen + [b["close"]])[-4:]
            top = max(top, b["high"])
            want = [total, before, sum(x for k, x in enumerate(seen) if k != 2) + sum(range(len(seen))), 5, 1 if b["close"] > b["open"] else -1, top, 4 + i, b["close"], sum(seen) / len(seen)]
            have = [g[n] for n in ("total", "streak", "sum", "k", "code", "top", "n", "memo", "avg")]
            assert all(x == y or (x is not None and math.isclose(x, y)) for x, y in zip(have, want)), (symbol, i, have, want)
            before = streak
    assert script.alerts(bars).count() == bars.where("close > open").count()


def test_strategy_is_the_set_at_a_time_backtest(spark):
    bars = event_bars(spark, SF)
    ledger = Script(STRATEGY).backtest(bars)
    marked = bars.withColumn("f", ta.sma("close", 5)).withColumn("s", ta.sma("close", 20))
    held = G.positions(marked.withColumn("a", ta.crossover("f", "s")).withColumn("b", ta.crossunder("f", "s")), "a", "b")
    key = lambda r: (r["symbol"], r["entry_bar"], r["exit_bar"], round(r["profit"], 6))
    assert sorted(map(key, ledger.collect())) == sorted(map(key, G.trades(held).collect()))
    assert Script(STRATEGY).run(bars).agg(F.max("size")).first()[0] == 1


def test_front_end():
    assert [t[0] for t in tokenize("if a\n    b\nc")] == ["key", "name", "nl", "indent", "name", "nl", "dedent", "name", "nl", "end"]
    tree = parse('indicator("t", overlay=true)\nx = (close +\n     open) / 2\ny = x >\n  1 ? 2 : 3\n')
    assert header(tree)[0] == "indicator" and len(tree) == 3
    found = inputs(parse('indicator("t")\na = input.int(3, "Len", minval=1)\nb = input(close, "Len")\n'))
    assert [f["title"] for f in found] == ["Len", "Len (2)"] and found[0]["min"] == 1
    for bad in ("x = ", "indicator('a')\nx = 1 +* 2", "x = 5 ? 1"):
        with pytest.raises(ScriptError):
            header(parse(bad))


def test_errors(spark):
    bars = event_bars(spark, SF).limit(5)
    for text, what in (('indicator("a")\nvar x = 0\nwhile true\n    x += 1\nplot(x, "x")', "too many turns"), ('indicator("a")\nf(x) => f(x)\nplot(f(1), "x")', "may not call"), ('indicator("a")\nplot(nope, "x")', "not declared")):
        with pytest.raises(Exception, match=what):
            Script(text).run(bars).collect()
