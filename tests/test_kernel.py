"""The script kernel: the clock, matrices, drawings, libraries, account statistics and ticks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.functions import matrices as X
from barframe.operators import broker as B
from barframe.operators import drawings as D
from barframe.operators import signals as G
from barframe.plans.clock import Chart, bucket, chart_of, inside, instant
from barframe.plans.grid import MATRIX, Grid
from barframe.plans.interp import Machine
from barframe.plans.lang import ScriptError, parse
from barframe.plans.modules import first_of, from_folder, from_mapping, resolve
from barframe.plans.script import Script
from barframe.streaming.live import Forming, Live, opening


def rows(n=30, seed=3):
    r = np.random.default_rng(seed)
    close = 100 + r.normal(size=n).cumsum()
    open_ = np.concatenate([[100.0], close[:-1]])
    wide = r.random(n)
    return pd.DataFrame({"symbol": "s", "time": pd.date_range("2024-01-30 20:00", periods=n, freq="h"), "open": open_, "high": np.maximum(open_, close) + wide, "low": np.minimum(open_, close) - wide, "close": close, "volume": r.integers(1, 9, n).astype(float)})


def machine(text, table=None, account=None, **values):
    table = rows() if table is None else table
    m = Machine(resolve(parse(text), None), values, account, chart_of(table, "60"), "s")
    for bar in B._bars(table):
        if account:
            account.run_bar(bar, lambda _, b: m.run_bar(b))
        else:
            m.run_bar(bar)
    return m


def plots(text, **given):
    return machine('indicator("x")\n' + text, **given).plots


# --- names


@pytest.mark.parametrize("text", ["plot(strategy.grossprofits)", "plot(foo.bar)", "plot(nothing)", "plot(request.nothing(close))", "plot(ta.nothing(close))", "x = line.nothing(na)\nplot(close)", "plot(barstate.nothing ? 1 : 0)"])
def test_unknown_names_are_errors(text):
    if "line.nothing" in text:
        text = "l = line.new(1, 2, 3, 4)\nl.nothing(2)\nplot(close)"
    with pytest.raises(ScriptError):
        plots(text)


def test_requests_without_data_are_na():
    got = plots('plot(request.dividends("a"), "d")\nplot(request.economic("US", "GDP"), "e")\nplot(nz(request.quandl("x"), 3), "q")')
    assert got == {"d": None, "e": None, "q": 3.0}


# --- the clock


def test_clock():
    got = plots(
        'plot(bar_index - last_bar_index, "left")\nplot(dayofweek(time_close), "dow")\nplot(timeframe.change("1D") ? 1 : 0, "new")\nplot(barstate.islast ? 1 : 0, "last")\nplot(timeframe.in_seconds("2D") + timeframe.multiplier, "tf")\n'
        'plot(time >= timestamp(2024, 1, 31, 0, 0) ? 1 : 0, "after")\nplot(hour(timestamp("2024-02-01 05:30")) + minute(timestamp("UTC+2", 2024, 1, 1, 12, 15)), "h")\nplot(na(time("60", "0900-1000")) ? 1 : 0, "out")\nplot(session.isfirstbar ? 1 : 0, "first")\nplot(chart.is_standard ? 1 : 0, "std")\n'
        'p = chart.point.now(high)\nq = chart.point.copy(p)\nplot(q.price - high + q.index - bar_index, "point")\nplot(dayofweek == dayofweek.thursday ? 1 : 0, "thu")'
    )
    assert got == {"left": 0, "dow": 5, "new": 0, "last": 1, "tf": 2 * 86400 + 60, "after": 1, "h": 5 + 15, "out": 1, "first": 0, "std": 1, "point": 0, "thu": 1}


def test_times():
    assert instant("2024-02-30") is None and instant("UTC-3", 2024, 1, 1, 22, 30) == pd.Timestamp("2024-01-02 01:30") and instant("Europe/Berlin", 2024, 7, 1) == pd.Timestamp("2024-06-30 22:00")
    t = pd.Timestamp("2024-02-29 23:59:59")
    for tf in ("1", "240", "1D", "3D", "1W", "2W", "1M", "3M"):
        assert bucket(opening(t, tf), tf) == bucket(t, tf) and bucket(opening(t, tf) - pd.Timedelta(seconds=1), tf) == bucket(t, tf) - 1
    assert inside(t, "2200-0100") and not inside(t, "0100-2200") and inside(t, "broken") and inside(t, "0000-0000:5") and not inside(t, "0000-0000:67")


# --- matrices against the matrix columns


def test_matrices(spark):
    r = np.random.default_rng(5)
    some = [r.integers(-3, 4, (n, n)).astype(float).tolist() for n in (1, 2, 3, 3, 4)] + [[[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0], [-2.0, 0.0]], [[0.5, 0.5], [0.25, 0.75]]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(some)], "i int, m array<array<double>>")
    m = F.col("m")
    reducers = {"trace": X.trace(m), "avg": X.avg(m), "median": X.median(m), "mode": X.mode(m), "det": X.det(m), "rank": X.rank(m).cast("double")}
    tests = {n: getattr(X, n)(m) for n in ("is_square", "is_zero", "is_binary", "is_identity", "is_diagonal", "is_antidiagonal", "is_symmetric", "is_antisymmetric", "is_triangular", "is_stochastic")}
    whole = {"inv": X.inv(m), "pinv": X.pinv(m), "transpose": X.transpose(m), "eigenvectors": X.eigenvectors(m)}
    for row in df.select("i", *[c.alias(n) for n, c in (reducers | tests | whole).items()]).collect():
        g = lambda: Grid([list(x) for x in some[row["i"]]])  # noqa: E731, B023
        for n in reducers:
            assert (row[n] is None) == (MATRIX[n](g()) is None) and (row[n] is None or math.isclose(row[n], MATRIX[n](g()), abs_tol=1e-9)), n
        for n in tests:
            assert row[n] == MATRIX[n](g()), (n, some[row["i"]])
        for n in whole:
            got = MATRIX[n](g())
            assert (row[n] is None) == (got is None) and (got is None or np.allclose(row[n], got.rows)), n


def test_matrix_edits():
    got = plots(
        'm = matrix.new<float>(2, 2, 1)\nm.add_row(1, array.from(4, 5))\nm.add_col(0, array.from(7, 8, 9))\nr = m.remove_row(0)\nc = m.remove_col()\nk = m.copy()\nk.fill(2)\nk.concat(m)\nplot(m.rows() * 10 + m.columns(), "shape")\nplot(r.sum() + c.sum(), "gone")\nplot(k.elements_count() + k.get(3, 1), "k")\nplot(m.get(9, 9), "na")'
    )
    assert got == {"shape": 22.0, "gone": 7 + 1 + 1 + 5 + 1, "k": 8 + 1, "na": None}


# --- drawings


def test_drawing_state(spark):
    log = D.Log("s", {**D.CAPS, "line": 2})
    a, b = log.new(0, "line", x1=0, y1=1.0, x2=2, y2=5.0), log.new(0, "line", x1=1, y1=1, x2=1, y2=2)
    assert log.price(a, 1) == 3.0 and log.price(b, 1) is None and log.get(a, "x2") == 2
    c = log.copy(1, "line", a)
    assert log.all("line") == [b, c] and log.copy(1, "line", a) is None and log.get(a, "x1") is None
    log.set(1, "line", "set_xy1", c, 7, 8)
    t = log.new(1, "table", position="top_left", columns=2, rows=2)
    log.cell(1, t, 0, 0, text="a", bgcolor="red")
    log.cell(1, t, 1, 1, text="b")
    log.set(2, "table", "cell_set_text", t, "c", cell=(1, 1))
    log.cell(2, t, 0, 0, text="z")
    log.clear(3, t, 1, 1, 1, 1)
    log.delete(3, "line", b)
    rows_ = [(*r[:6], r[6]) for r in log.rows]
    got = {(r["type"], r["id"]): r["props"] for r in D.final_state(spark.createDataFrame(rows_, D.EVENTS), {**D.CAPS, "line": 2}).collect()}
    assert got == {("line", c): {"x1": "7", "y1": "8", "x2": "2", "y2": "5.0"}, ("table", t): {"position": "top_left", "columns": "2", "rows": "2", "cell:0:0:text": "z"}}


def test_drawings_in_scripts():
    m = machine(
        'indicator("x")\nvar line top = na\nif barstate.isfirst\n    top := line.new(chart.point.from_index(0, 10), chart.point.from_index(10, 20), color = color.blue)\nelse\n    top.set_second_point(chart.point.from_index(bar_index, 20))\n'
        'o = line.new(bar_index, low, bar_index, high)\nf = linefill.new(top, o, color.red)\nb = box.new(bar_index, high, bar_index + 1, low)\nb.set_right(bar_index + 2)\nt = table.new(position.top_right, 1, 1)\ntable.cell(t, 0, 0, "v", text_color = color.red)\n'
        'plot(line.get_price(top, bar_index / 2.0), "mid")\nplot(f.get_line1().get_y1(), "y")\nplot(box.all.size(), "boxes")\nplot(b.get_right() - bar_index, "right")\nl = label.new(bar_index, high, "t")\nl.set_text("u")\nplot(l.get_text() == "u" ? 1 : 0, "u")\nk = label(na)\nplot(na(k) ? 1 : 0, "na")'
    )
    assert m.plots == {"mid": 15.0, "y": 10.0, "boxes": 30.0, "right": 2.0, "u": 1.0, "na": 1.0}
    assert m.log.get(1, "x2") == 29 and m.log.get(m.log.all("table")[-1], "cell:0:0:text") == "v"


# --- libraries

BOOK = 'library("b")\nimport h/a/1 as q\nhidden(x) =>\n    x + 1\nexport f(float x) =>\n    hidden(q.g(x))\nexport type P\n    float v = 2\nexport enum E\n    one = "1"\n'
TEXTS = {"h/a/1": 'library("a")\nexport g(x) =>\n    var n = 0\n    n += 1\n    x * 10 + n\n', "h/b/1": BOOK}


def test_libraries():
    text = 'indicator("x")\nimport h/b/1 as b\np = b.P.new()\nplot(b.f(1) + p.v, "f")\nplot(b.f(1), "own state")\nplot(b.E.one == "1" ? 1 : 0, "e")'
    m = Machine(resolve(parse(text), from_mapping(TEXTS)))
    for bar in B._bars(rows(3)):
        m.run_bar(bar)
    assert m.plots == {"f": 10 + 3 + 1 + 2, "own state": 14, "e": 1}


@pytest.mark.parametrize(
    ("main", "books"),
    [
        ("import h/z/1", {}), ("import h/a/1\nplot(a.no(1))", TEXTS), ("import h/b/1\nplot(b.hidden(1))", TEXTS), ("import h/p/1\nplot(p.f(1))", {"h/p/1": 'library("p")\nexport f(x) =>\n    plot(x)\n    x\n'}),
        ("import h/c/1\nplot(close)", {"h/c/1": 'library("c")\nimport h/d/1\nexport f(x) =>\n    x\n', "h/d/1": 'library("d")\nimport h/c/1\nexport f(x) =>\n    x\n'}), ("import h/i/1\nplot(close)", {"h/i/1": 'indicator("i")\nplot(close)\n'}), ("import h/a\nplot(close)", TEXTS),
    ],
)
def test_library_errors(main, books):
    with pytest.raises(ScriptError):
        m = Machine(resolve(parse('indicator("x")\n' + main), from_mapping(books)))
        m.run_bar(B._bars(rows(1))[0])


def test_library_loaders(tmp_path):
    (tmp_path / "h" / "a").mkdir(parents=True)
    (tmp_path / "h" / "a" / "1.txt").write_text(TEXTS["h/a/1"])
    load = first_of(from_folder(tmp_path), from_mapping({"h/b/1": BOOK}))
    assert load("h/a/1") == TEXTS["h/a/1"] and load("h/b/1") == BOOK and load("h/c/1") is None


# --- accounts


def test_reads_and_trades():
    a = B.Account(B.Settings(initial_capital=1000, commission_value=1.0, commission_type="cash_per_order"))
    m = machine(
        'strategy("x", initial_capital = 1000)\nif bar_index % 6 == 1\n    strategy.entry("L" + str.tostring(bar_index), strategy.long, 2)\nif bar_index % 6 == 4\n    strategy.entry("S", strategy.short, 1)\nplot(strategy.closedtrades.size(strategy.closedtrades - 2), "size")\nplot(strategy.grossprofit - strategy.grossloss - strategy.netprofit, "net")\n'
        'plot(strategy.wintrades + strategy.losstrades + strategy.eventrades - strategy.closedtrades, "n")\nplot(strategy.opentrades.commission(0), "fee")\nplot(strategy.closedtrades.max_runup_percent(0), "up")\nplot(strategy.closedtrades.commission(99), "none")\nplot(strategy.default_entry_qty(close), "qty")\nplot(strategy.convert_to_account(5), "five")',
        account=a,
    )
    t = a.ledger[0]
    assert m.plots["size"] == -1 and abs(m.plots["net"]) < 1e-9 and m.plots["n"] == 0 and m.plots["fee"] == 1.0 and m.plots["none"] is None and m.plots["five"] == 5
    assert math.isclose(m.plots["up"], 100 * t["max_runup"] / (t["entry_price"] * t["qty"]))
    assert a.read("position_entry_name") == a.lots[0].id and a.read("max_contracts_held_long") == 2 and a.read("max_contracts_held_short") == 1
    assert a.read("avg_losing_trade") >= 0 and a.read("max_drawdown_percent") > 0 and a.read("margin_liquidation_price") == a.liquidation_price()
    assert a.trade(True, "nothing", 0) is None and a.trade(False, "profit_percent", 0) is not None and set(B.READS) >= {"eventrades", "account_currency", "closedtrades.first_index"}


def test_weights():
    with pytest.raises(ValueError):
        G.weighted_sleeves(None, {"a": 0.0}, 10)
    with pytest.raises(ValueError):
        G.weighted_sleeves(None, {}, 10)


# --- ticks

TICKED = 'indicator("x")\nvar int n = 0\nvarip int ticks = 0\nn += 1\nticks += 1\nplot(n, "n")\nplot(ticks, "ticks")\nplot(ta.ema(close, 3), "e")\nplot(ta.supertrend(2, 3).first(), "st")\nplot(close[1], "p")\nplot(barstate.isconfirmed ? 1 : 0, "c")\nplot(barstate.isnew ? 1 : 0, "new")\nl = label.new(bar_index, high, "x")\nplot(label.all.size(), "labels")'


def test_ticks_roll_back():
    """Every close of a bar gives what a batch gives, however many ticks came before; varip counts them all."""
    table = rows(20)
    batch = machine(TICKED, table)
    live, last, count = Live(Script(TICKED), "s"), None, 0
    for r in table.itertuples(index=False):
        forming = Forming(r.time, r.open, r.open, r.open, r.open, 0.0, 0)
        for k, price in enumerate((r.high, r.low, (r.high + r.low) / 2, r.close)):
            forming.add(price, r.volume / 4)
            got = live.tick(forming, k == 3)
            count += 1
            assert got["c"] == (k == 3) and got["new"] == (k == 0) and got["ticks"] == count
        last = got
    skip = {"ticks", "c", "new"}
    assert {k: v for k, v in last.items() if k not in skip} == {k: v for k, v in batch.plots.items() if k not in skip}
    assert last["n"] == 20 and last["labels"] == 20


def test_history_then_ticks():
    table = rows(12)
    live = Live(Script(TICKED), "s")
    live.history(table[:10])
    r = table.iloc[10]
    first = live.tick(Forming(r.time, r.open, r.open, r.open, r.open, 1.0), False)
    again = live.tick(Forming(r.time, r.open, r.high, r.low, r.close, r.volume, 2), True)
    assert first["n"] == again["n"] == 11 and first["e"] != again["e"] and math.isclose(again["e"], machine(TICKED, table[:11]).plots["e"])


def test_chart_is_immutable():
    assert Chart("60").live(False, True).realtime and not Chart("60").realtime
