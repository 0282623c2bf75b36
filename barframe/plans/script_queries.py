"""Registered queries of the script language and of strategy reports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.operators import drawings as D
from barframe.operators import security as Q
from barframe.operators import signals as G
from barframe.operators.magnifier import magnified
from barframe.plans.modules import from_mapping
from barframe.plans.script import Script
from barframe.sources.bars import event_bars
from barframe.streaming import bars as S2
from barframe.streaming.live import script_stream

REQUESTS = """
indicator("requests")
[c, h, m] = request.security(syminfo.tickerid, "1D", [close, high, ta.sma(close, 3)], lookahead = {ahead})
plot(c, "dc")
plot(h, "dh")
plot(m, "dm")
"""
OTHER = """
indicator("another symbol")
plot(request.security("click", "1D", close), "dc")
"""
LOWER = """
indicator("finer bars")
lc = request.security_lower_tf(syminfo.tickerid, "60", close)
lv = request.security_lower_tf(syminfo.tickerid, "60", volume)
plot(lc.size(), "n")
plot(lc.sum(), "s")
plot(lc.first(), "f")
plot(lc.last(), "l")
plot(lv.max(), "v")
"""
DATES = """
indicator("dates")
{memory}
plot(year, "year")
plot(month, "month")
plot(dayofmonth, "dayofmonth")
plot(dayofweek, "dayofweek")
plot(hour, "hour")
plot(minute, "minute")
plot(second, "second")
plot(weekofyear, "weekofyear")
"""
FLOW = """
indicator("volume")
var int seen = 0
seen += 1
plot(ta.accdist, "ad")
plot(ta.wad, "wad")
plot(ta.pvt, "pvt")
plot(ta.iii, "iii")
plot(ta.percentile_nearest_rank(close, 10, 75), "p")
plot(last_bar_index - bar_index, "left")
"""
MATRIX = """
indicator("matrices")
m = matrix.new<float>(2, 2, 0)
m.set(0, 0, open)
m.set(0, 1, high)
m.set(1, 0, low)
m.set(1, 1, close)
p = m.mult(m)
t = m.transpose()
k = m.kron(m)
v = m.mult(array.from(open, close))
c = m.copy()
c.swap_rows(0, 1)
s = m.submatrix(1, 2, 0, 2)
m2 = m.copy()
m2.reshape(1, 4)
plot(m.trace(), "tr")
plot(t.get(0, 1), "t01")
plot(p.get(0, 1), "mm")
plot(v.get(1), "mv")
plot(m.sum(m).get(1, 1), "sm")
plot(m.diff(1.0).get(0, 0), "df")
plot(m.avg(), "av")
plot(m.max(), "mx")
plot(m.min(), "mi")
plot(m.median(), "md")
plot(c.get(0, 0), "sw")
plot(m2.get(0, 2), "rs")
plot(s.get(0, 1), "sb")
plot(k.get(0, 3), "kr")
plot(m.rows() * 10 + m2.columns(), "sh")
"""
ARRAYS = """
indicator("arrays")
var a = array.new_float(0)
a.push(close)
if a.size() > 6
    a.shift()
full = a.size() == 6
b = a.copy()
b.sort()
f = array.new_int(2, 7)
e = a.copy()
e.clear()
plot(full ? a.sum() : na, "s")
plot(full ? a.avg() : na, "m")
plot(full ? a.median() : na, "md")
plot(full ? a.variance() : na, "vr")
plot(full ? a.percentile_nearest_rank(50) : na, "p1")
plot(full ? a.lastindexof(close) : na, "li")
plot(full ? b.binary_search_leftmost(100) : na, "bl")
plot(full ? b.binary_search(b.get(2)) : na, "bs")
plot(e.size() + f.get(1), "e")
"""
BOOKS = {
    "house/smooth/1": 'library("smooth")\ntwice(float x) =>\n    x * 2\nexport mean(float x, int n = 3) =>\n    m = ta.sma(x, n)\n    twice(m) / 2\nexport const float HALF = 0.5\nexport enum Way\n    up = "U"\n    down = "D"\n',
    "house/spread/2": 'library("spread")\nimport house/smooth/1 as s\nexport method over(float x, int n) =>\n    x - s.mean(x, n)\n',
}
LIBRARY = """
indicator("libraries")
import house/smooth/1 as sm
import house/spread/2
plot(sm.mean(close, 4) * {half}, "mean")
plot(spread.over(close, 5), "over")
"""
STRATEGY = """
strategy("cross", initial_capital = 10000)
f = math.round(ta.sma(close, 5), 8)
s = math.round(ta.sma(close, 20), 8)
if ta.crossover(f, s)
    strategy.entry("long", strategy.long)
if ta.crossunder(f, s)
    strategy.close("long")
n = strategy.closedtrades - 1
plot(strategy.closedtrades, "closed")
plot(strategy.closedtrades.profit(n), "profit")
plot(strategy.closedtrades.profit_percent(n), "percent")
plot(strategy.closedtrades.entry_price(n), "entry_price")
plot(strategy.closedtrades.exit_price(n), "exit_price")
plot(strategy.closedtrades.entry_bar_index(n), "entry_bar")
plot(strategy.closedtrades.exit_bar_index(n), "exit_bar")
plot(strategy.closedtrades.size(n), "size")
plot(strategy.closedtrades.cumprofit(n), "cum")
plot(strategy.opentrades, "open_trades")
plot(strategy.opentrades.entry_price(0), "open_price")
plot(strategy.opentrades.profit(0), "open_profit")
plot(strategy.opentrades.entry_bar_index(0), "open_bar")
plot(strategy.position_size, "position")
"""
DRAWINGS = """
indicator("drawings")
l = line.new(bar_index, low, bar_index + 1, high, color = color.red)
l.set_y2(close)
if bar_index % 3 == 0
    l.delete()
b = label.new(bar_index, l.get_y1(), "b")
b.set_text(str.tostring(line.all.size()))
"""
LIVE = """
indicator("live")
var int ups = 0
if close > open
    ups += 1
plot(ta.sma(close, 5), "mean")
plot(ups, "ups")
plot(close[1], "before")
plot(ta.highest(3) - ta.lowest(3), "wide")
"""
OUTPUTS = """
indicator("outputs")
p = plot(close, "close")
q = plot(open, "open")
fill(p, q, color.red, "area")
hline(100, "level")
plotcandle(open, high, low, close[1], "candles", color = close > open ? color.green : color.red)
plotbar(open, high, low, close, "bars")
bgcolor(close > open ? color.green : na, title = "back")
barcolor(close < open ? color.red : na, title = "bar")
plotshape(close > open, "up", shape.triangleup, location.belowbar, color.green, text = "U")
"""


def register_all(register: Callable, bars_query: Callable, sql: dict[str, str], h: dict) -> None:
    """``h`` has the catalogue's helpers by name, ``sql`` the texts so far."""
    bars_cte, r6, q6, w, cum, frame = (h[x] for x in ("BARS", "r6", "q6", "W", "CUM", "frame"))

    def script(name: str, text: str, oracle: str, columnar: bool = True, doubles: list[str] | None = None, casts: dict[str, str] | None = None, prepare: Callable | None = None, **given) -> None:
        def run(s: SparkSession, d: str) -> DataFrame:
            bars = event_bars(s, d)
            more = {k: f(bars) if callable(f) and k != "libraries" else f for k, f in given.items()}
            got = Script(text, **more).run(prepare(bars) if prepare else bars, columnar)
            names = doubles or [c for c in got.columns if c not in ("symbol", "time") and c not in (casts or {})]
            return got.select("symbol", "time", *[r6(F.col(n)).alias(n) for n in names], *[F.col(n).cast(t).alias(n) for n, t in (casts or {}).items()])

        register(name, run, oracle)

    def plain(columns: dict[str, str], ctes: str = "", source: str = "b") -> str:
        return f"WITH RECURSIVE {bars_cte}{ctes} SELECT symbol, time, {', '.join(f'{q6(x)} AS {n}' for n, x in columns.items())} FROM {source}"

    # --- requests in both backends
    for ahead in ("off", "on"):
        for way in ("columns", "kernel"):
            script(f"script_security_{ahead}_{way}", REQUESTS.format(ahead=f"barmerge.lookahead_{ahead}"), sql[f"security_htf_{ahead}"], way == "columns")
    script("script_security_other", OTHER, sql["security_cross_symbol"])
    script("script_lower_tf", LOWER, sql["security_lower_tf"], casts={"n": "long"}, doubles=["s", "f", "l", "v"], timeframe="1D", lower=lambda b: b, prepare=lambda b: Q.resample(b, "1D").drop("bucket"))
    # --- the clock, indicators and collections
    dates = {n: "int" for n in ("year", "month", "dayofmonth", "dayofweek", "hour", "minute", "second", "weekofyear")}
    script("script_dates_columns", DATES.format(memory=""), sql["date_parts"], doubles=[], casts=dates)
    script("script_dates_kernel", DATES.format(memory="var int n = 0"), sql["date_parts"], doubles=[], casts=dates)
    move = "CASE WHEN close > pc THEN close - least(pc, low) WHEN close < pc THEN close - greatest(pc, high) ELSE 0 END"
    script("script_flow", FLOW, plain({
        "ad": f"sum(CASE WHEN high = low THEN 0 ELSE ((close-low)-(high-close))/(high-low)*volume END) OVER {cum}", "wad": f"sum({move}) OVER {cum}", "pvt": f"coalesce(sum((close-pc)/nullif(pc,0)*volume) OVER {cum}, 0)",
        "iii": "coalesce((2*close-high-low)/nullif((high-low)*volume,0),0)", "p": f"CASE WHEN i >= 10 THEN list_sort(list(close) OVER {frame(10)})[8] END", "left": "count(*) OVER (PARTITION BY symbol) - i",
    }))
    script("script_matrix", MATRIX, plain({
        "tr": "open+close", "t01": "low", "mm": "open*high+high*close", "mv": "low*open+close*close", "sm": "2*close", "df": "open-1", "av": "(open+high+low+close)/4", "mx": "greatest(open,high,low,close)", "mi": "least(open,high,low,close)",
        "md": "list_median([open,high,low,close])", "sw": "low", "rs": "low", "sb": "close", "kr": "high*high", "sh": "24",
    }))
    arrays = f", a0 AS (SELECT *, list(close) OVER {frame(6)} AS a FROM b)"
    six = lambda x: f"CASE WHEN i >= 6 THEN {x} END"
    below = "len(list_filter(a, lambda y: y < 100))"
    script("script_arrays", ARRAYS, plain({
        "s": six("list_sum(a)"), "m": six("list_avg(a)"), "md": six("list_median(a)"), "vr": six("list_var_pop(a)"), "p1": six("list_sort(a)[3]"), "li": six("5"), "bl": six(f"CASE WHEN list_contains(a, 100) THEN {below} ELSE {below} - 1 END"),
        "bs": six("list_position(list_sort(a), list_sort(a)[3]) - 1"), "e": "7",
    }, arrays, "a0"))
    mean = lambda n: f"CASE WHEN i >= {n} THEN avg(close) OVER {frame(n)} END"
    script("script_libraries", LIBRARY.format(half="1"), plain({"mean": mean(4), "over": f"close - {mean(5)}"}), libraries=from_mapping(BOOKS))
    script("script_libraries_kernel", LIBRARY.format(half="sm.HALF"), plain({"mean": f"0.5::DOUBLE * {mean(4)}", "over": f"close - {mean(5)}"}), False, libraries=from_mapping(BOOKS))
    # --- strategies: what programs read of their account and trades
    turns = h["turn_cte"]
    trades = turns + ", n1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_time) AS n, sum(profit) OVER (PARTITION BY symbol ORDER BY entry_time ROWS UNBOUNDED PRECEDING) AS c FROM tr)"
    now = trades + ", t2 AS (SELECT symbol, time AS entry_time, i-1 AS entry_bar, open AS entry_price FROM t0 WHERE pos=1), o1 AS (SELECT b.*, n1.n, n1.profit, n1.entry_price AS ep, n1.exit_price AS xp, n1.entry_bar AS eb, n1.exit_bar AS xb, n1.c FROM b ASOF LEFT JOIN n1 ON n1.symbol=b.symbol AND n1.exit_time<=b.time), o2 AS (SELECT o1.*, h2.pos FROM o1 JOIN h2 USING (symbol, time)), o3 AS (SELECT o2.*, t2.entry_price AS op, t2.entry_bar AS ob FROM o2 ASOF LEFT JOIN t2 ON t2.symbol=o2.symbol AND t2.entry_time<=o2.time)"
    script("script_trades", STRATEGY, plain({
        "closed": "coalesce(n, 0)", "profit": "profit", "percent": "100*profit/nullif(ep, 0)", "entry_price": "ep", "exit_price": "xp", "entry_bar": "eb", "exit_bar": "xb", "size": "CASE WHEN n IS NOT NULL THEN 1 END", "cum": "c", "open_trades": "pos",
        "open_price": "CASE WHEN pos=1 THEN op END", "open_profit": "CASE WHEN pos=1 THEN close-op END", "open_bar": "CASE WHEN pos=1 THEN ob END", "position": "pos",
    }, now, "o3"))
    reads = {
        "netprofit": "coalesce(sum(profit), 0)", "netprofit_percent": "coalesce(sum(profit), 0)/100", "grossprofit": "coalesce(sum(profit) FILTER (profit>0), 0)", "grossprofit_percent": "coalesce(sum(profit) FILTER (profit>0), 0)/100",
        "grossloss": "-coalesce(sum(profit) FILTER (profit<0), 0)", "grossloss_percent": "-coalesce(sum(profit) FILTER (profit<0), 0)/100", "closedtrades": "count(profit)", "wintrades": "count(*) FILTER (profit>0)", "losstrades": "count(*) FILTER (profit<0)", "eventrades": "count(*) FILTER (profit=0)",
        "avg_trade": "coalesce(avg(profit), 0)", "avg_winning_trade": "coalesce(avg(profit) FILTER (profit>0), 0)", "avg_losing_trade": "-coalesce(avg(profit) FILTER (profit<0), 0)", "avg_trade_percent": "coalesce(avg(100*profit/nullif(abs(entry_price),0)), 0)",
        "avg_winning_trade_percent": "coalesce(avg(100*profit/nullif(abs(entry_price),0)) FILTER (profit>0), 0)", "avg_losing_trade_percent": "-coalesce(avg(100*profit/nullif(abs(entry_price),0)) FILTER (profit<0), 0)", "initial_capital": "10000",
    }
    ends = {
        "opentrades": "pos", "position_size": "pos", "openprofit": "CASE WHEN pos=1 THEN close-op ELSE 0 END", "openprofit_percent": "CASE WHEN pos=1 THEN close-op ELSE 0 END / 100", "position_avg_price": "CASE WHEN pos=1 THEN op END", "opentrades.capital_held": "CASE WHEN pos=1 THEN abs(op) ELSE 0 END",
        "equity": "10000 + net + CASE WHEN pos=1 THEN close-op ELSE 0 END", "max_contracts_held_all": "held", "max_contracts_held_long": "held", "max_contracts_held_short": "0", "closedtrades.first_index": "CASE WHEN n > 0 THEN 0 END",
    }
    named = {n: n.replace(".", "_") for n in (*reads, *ends)}
    register(
        "script_reads",
        lambda s, d: (lambda got: got.select("symbol", *[r6(F.col(f"`{n}`")).alias(a) for n, a in named.items()], F.col("position_entry_name").alias("position_entry_name"), F.col("account_currency").alias("account_currency")))(Script(STRATEGY).reads(event_bars(s, d))),
        f"""WITH {bars_cte}{now}, lastbar AS (SELECT * FROM o3 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1), totals AS (SELECT s.symbol, {', '.join(f'{x} AS {named[n]}' for n, x in reads.items())} FROM (SELECT DISTINCT symbol FROM b) s LEFT JOIN tr USING (symbol) GROUP BY s.symbol),
        ever AS (SELECT symbol, max(pos) AS held FROM h2 GROUP BY symbol), r0 AS (SELECT lastbar.* EXCLUDE (n), totals.* EXCLUDE (symbol), totals.netprofit AS net, totals.closedtrades AS n, held FROM lastbar JOIN totals USING (symbol) JOIN ever USING (symbol))
        SELECT symbol, {', '.join(f'{q6(named[n])} AS {named[n]}' for n in reads)}, {', '.join(f'{q6(x)} AS {named[n]}' for n, x in ends.items())}, CASE WHEN pos=1 THEN 'long' ELSE '' END AS position_entry_name, 'USD' AS account_currency FROM r0""",
    )
    # --- live: closed bars of a tick stream; a symbol's last bar is still open
    def ticks(s: SparkSession, d: str) -> DataFrame:
        return S2.tick_stream(s, d, "events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tie"))

    register(
        "script_live", lambda s, d: S2.replay(script_stream(ticks(s, d), Script(LIVE), every_tick=False)).where("confirmed").select("symbol", "time", "ticks", *[r6(F.col(n)).alias(n) for n in ("mean", "ups", "before", "wide")]),
        f"WITH {bars_cte}, x1 AS (SELECT *, CASE WHEN i >= 5 THEN avg(close) OVER {frame(5)} END AS m, sum((close > open)::INT) OVER {cum} AS ups, max(high) OVER {frame(3)} - min(low) OVER {frame(3)} AS wide, max(i) OVER (PARTITION BY symbol) AS n FROM b) SELECT symbol, time, volume::BIGINT AS ticks, {q6('m')} AS mean, {q6('ups')} AS ups, {q6('pc')} AS before, {q6('CASE WHEN i >= 3 THEN wide END')} AS wide FROM x1 WHERE i < n",
    )
    # --- finer bars inside chart bars
    register(
        "magnifier_buckets",
        lambda s, d: (lambda b: magnified(Q.resample(b, "240").drop("bucket"), b, "240", cap=500).select("symbol", "time", "coverage", F.size("lower").cast("long").alias("n"), r6(F.aggregate("lower", F.lit(0.0), lambda a, x: a + x["close"])).alias("total")))(event_bars(s, d)),
        f"""WITH {bars_cte}, c0 AS (SELECT symbol, min(time) AS t FROM b GROUP BY symbol, floor(epoch(time)/14400)), c1 AS (SELECT symbol, t, least(t + INTERVAL 4 HOUR, coalesce(lead(t) OVER (PARTITION BY symbol ORDER BY t), t + INTERVAL 4 HOUR)) AS e FROM c0),
        j AS (SELECT c1.symbol, c1.t, b.close, row_number() OVER (PARTITION BY c1.symbol ORDER BY b.time DESC) <= 500 AS kept FROM c1 JOIN b ON b.symbol=c1.symbol AND b.time>=c1.t AND b.time<c1.e), g AS (SELECT symbol, t, bool_and(kept) AS whole, count(*) AS n, sum(close) AS s FROM j GROUP BY symbol, t)
        SELECT symbol, t AS time, CASE WHEN whole THEN 'available' ELSE 'cap' END AS coverage, CASE WHEN whole THEN n ELSE 0 END AS n, {q6('CASE WHEN whole THEN s ELSE 0 END')} AS total FROM g""",
    )
    # --- drawings and outputs
    register(
        "script_drawings",
        lambda s, d: (lambda got: got.select("symbol", "type", "id", r6(F.col("props")["x1"]).alias("x1"), r6(F.col("props")["y1"]).alias("y1"), r6(F.col("props")["y2"]).alias("y2"), r6(F.col("props")["y"]).alias("y"), F.col("props")["text"].alias("text")))(D.final_state(Script(DRAWINGS).drawings(event_bars(s, d)))),
        # a bar makes two objects: line 2i-1, label 2i; of 50 lines at most, those of every third bar are gone
        f"""WITH {bars_cte}, made AS (SELECT *, (i-1) % 3 = 0 AS gone FROM b), kept AS (SELECT *, sum((NOT gone)::INT) OVER {cum} AS alive FROM made), there AS (SELECT *, least(alive, CASE WHEN gone THEN 49 ELSE 50 END) AS held FROM kept),
        l AS (SELECT symbol, 'line' AS type, 2*i-1 AS id, {q6('i-1')} AS x1, {q6('low')} AS y1, {q6('close')} AS y2, NULL::DOUBLE AS y, NULL::VARCHAR AS text FROM made JOIN (SELECT symbol, arg_max(held, i) AS top FROM there GROUP BY symbol) USING (symbol) WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= top),
        t AS (SELECT symbol, 'label' AS type, 2*i AS id, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS y2, CASE WHEN NOT gone THEN {q6('low')} END AS y, held::INT::VARCHAR AS text FROM there QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 50) SELECT * FROM l UNION ALL SELECT * FROM t""",
    )
    rows = {
        "fill": ("i = 1", "'area'"), "hline": ("i = 1", "'level'"), "plotcandle": ("pc IS NOT NULL", "'candles'"), "plotbar": ("true", "'bars'"), "bgcolor": ("close > open", "'back'"), "barcolor": ("close < open", "'bar'"), "plotshape": ("close > open", "'up'"),
    }
    color = {"plotcandle": "CASE WHEN close > open THEN '#4CAF50FF' ELSE '#F23645FF' END", "bgcolor": "'#4CAF50FF'", "barcolor": "'#F23645FF'", "plotshape": "'#4CAF50FF'", "fill": "'#F23645FF'"}
    register(
        "script_outputs", lambda s, d: Script(OUTPUTS).outputs(event_bars(s, d)).select("symbol", "bar_index", "kind", "title", F.col("props")["color"].alias("color")),
        f"WITH {bars_cte} " + " UNION ALL ".join(f"SELECT symbol, i-1 AS bar_index, '{k}' AS kind, {t} AS title, {color.get(k, 'NULL::VARCHAR')} AS color FROM b WHERE {on}" for k, (on, t) in rows.items()),
    )
    # --- reports
    held = h["held"]

    def curve(s: SparkSession, d: str) -> DataFrame:
        return G.equity(held(event_bars(s, d)), 10_000.0)

    report = [
        "periods_per_year", "sharpe", "sortino", "volatility_percent", "cagr_percent", "calmar", "exposure_percent", "expectancy", "largest_win", "largest_loss", "avg_bars_in_trade", "avg_bars_in_winners", "avg_bars_in_losers", "avg_win_loss_ratio", "largest_win_percent_of_gross_profit",
        "largest_loss_percent_of_gross_loss", "net_profit_percent_of_largest_loss", "return_on_capital_percent", "buy_hold_return_percent", "buy_hold_pnl", "outperformance", "max_runup_percent_of_capital", "max_drawdown_percent_of_capital", "max_drawdown_percent", "avg_runup", "avg_drawdown", "avg_runup_days", "avg_drawdown_days",
    ]
    eq = h["eq_cte"]
    r4 = lambda x: f"round(({x})::DOUBLE, 4) + 0.0"
    stats = f""", e1 AS (SELECT *, equity/lag(equity) OVER {w} - 1 AS r, max(equity) OVER {cum} - equity AS dd, 100*(max(equity) OVER {cum} - equity)/(max(equity) OVER {cum}) AS ddp, equity - min(equity) OVER {cum} AS ru FROM q2),
      e2 AS (SELECT symbol, epoch(max(time) - min(time))/31557600 AS years, count(*) AS bars, avg(r) AS mean, stddev_pop(r) AS sd, sqrt(avg(r*r) FILTER (r < -1e-12)) AS down, max(dd) AS mdd, max(ddp) AS mddp, max(ru) AS mru, avg(pos) AS inm, arg_max(equity, time) AS final, max(open) FILTER (i=2) AS second, arg_max(close, time) AS lastc FROM e1 GROUP BY symbol),
      tg AS (SELECT symbol, count(*) AS n, sum(profit) AS net, sum(profit) FILTER (profit>0) AS won, -sum(profit) FILTER (profit<0) AS lost, max(profit) FILTER (profit>0) AS best, max(-profit) FILTER (profit<0) AS worst, avg(profit) FILTER (profit>0) AS mw, avg(-profit) FILTER (profit<0) AS ml, avg(exit_bar-entry_bar) AS h, avg(exit_bar-entry_bar) FILTER (profit>0) AS hw, avg(exit_bar-entry_bar) FILTER (profit<0) AS hl, arg_min(entry_price, entry_bar) AS fp FROM tr GROUP BY symbol),
      ph1 AS (SELECT symbol, time, equity, coalesce(equity >= max(equity) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS dry FROM q2), ph2 AS (SELECT *, sum(dry::INT) OVER {cum} AS g FROM ph1),
      ph3 AS (SELECT symbol, g, max(equity) FILTER (dry) AS top, max(time) FILTER (dry) AS pk, min(equity) FILTER (NOT dry) AS low, arg_min(time, (equity, time)) FILTER (NOT dry) AS lowat FROM ph2 GROUP BY symbol, g),
      ph4 AS (SELECT *, lead(pk) OVER (PARTITION BY symbol ORDER BY g) AS nxt, coalesce(last_value(low IGNORE NULLS) OVER pw, first_value(top) OVER (PARTITION BY symbol ORDER BY g)) AS frm, coalesce(last_value(lowat IGNORE NULLS) OVER pw, first_value(pk) OVER (PARTITION BY symbol ORDER BY g)) AS since FROM ph3 WINDOW pw AS (PARTITION BY symbol ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      ph5 AS (SELECT symbol, avg(top-frm) FILTER (up) AS ar, avg(epoch(pk-since)/86400) FILTER (up) AS ard, avg(top-low) FILTER (dn) AS ad, avg(epoch(nxt-pk)/86400) FILTER (dn) AS addd FROM (SELECT *, (low IS NOT NULL OR nxt IS NULL) AND top>frm AS up, low IS NOT NULL AND nxt IS NOT NULL AS dn FROM ph4) GROUP BY symbol),
      z0 AS (SELECT e2.*, tg.* EXCLUDE (symbol), ph5.* EXCLUDE (symbol), (bars-1)/years AS ppy, coalesce(net,0) AS np, coalesce(lastc/nullif(CASE WHEN fp>0 THEN fp ELSE second END,0)-1,0) AS hold FROM e2 LEFT JOIN tg USING (symbol) JOIN ph5 USING (symbol)),
      z AS (SELECT *, coalesce((pow(final/10000, 1/years)-1)*100, 0) AS cagr FROM z0)"""
    exprs = [
        "ppy", "coalesce(mean/nullif(sd,0)*sqrt(ppy),0)", "coalesce(mean/nullif(down,0)*sqrt(ppy), CASE WHEN mean<=0 THEN 0 END)", "sd*sqrt(ppy)*100", "cagr", "coalesce(cagr/nullif(mddp,0),0)", "100*inm", "coalesce(np/nullif(n,0),0)", "coalesce(best,0)", "-coalesce(worst,0)", "coalesce(h,0)", "coalesce(hw,0)", "coalesce(hl,0)", "coalesce(mw/nullif(ml,0),0)", "coalesce(100*best/won,0)",
        "coalesce(100*worst/lost,0)", "coalesce(100*np/nullif(worst,0),0)", "np/100", "100*hold", "10000*hold", "np-10000*hold", "mru/100", "mdd/100", "mddp", "coalesce(ar,0)", "coalesce(ad,0)", "coalesce(ard,0)", "coalesce(addd,0)",
    ]
    register(
        "strategy_report", lambda s, d: (lambda c: G.strategy_report(c, G.trades(held(event_bars(s, d))), 10_000.0).select("symbol", *[(F.round(F.col(n).cast("double"), 4) + 0.0).alias(n) for n in report]))(curve(s, d)),
        f"WITH {bars_cte}{turns}{eq[len(h['sig_cte']):]}{stats} SELECT symbol, {', '.join(f'{r4(x)} AS {n}' for n, x in zip(report, exprs))} FROM z",
    )
    weights = {"click": 1.0, "view": 3.0}
    sleeves = f""", u0 AS (SELECT symbol, time, equity * CASE symbol WHEN 'click' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS equity FROM q2 WHERE symbol IN ('click', 'view')), u1 AS (SELECT DISTINCT time FROM u0), u2 AS (SELECT u1.time, s.symbol, s.c FROM u1, (SELECT 'click' AS symbol, 2500 AS c UNION ALL SELECT 'view', 7500) s),
      u3 AS (SELECT u2.time, coalesce(u0.equity, u2.c) AS e FROM u2 ASOF LEFT JOIN u0 ON u0.symbol=u2.symbol AND u0.time<=u2.time), u4 AS (SELECT time, sum(e) AS equity FROM u3 GROUP BY time)"""
    register("portfolio_weights", lambda s, d: G.portfolio_equity(curve(s, d), weights, 10_000.0).select("time", F.round("equity", 4).alias("equity")), f"WITH {bars_cte}{eq}{sleeves} SELECT time, round(equity, 4) AS equity FROM u4")
    register(
        "portfolio_extremes", lambda s, d: G.portfolio_extremes(G.portfolio_equity(curve(s, d), weights, 10_000.0)).select(F.round("max_drawdown", 3).alias("max_drawdown"), F.round("max_runup", 3).alias("max_runup")),
        f"WITH {bars_cte}{eq}{sleeves}, u5 AS (SELECT max(equity) OVER c - equity AS dd, equity - min(equity) OVER c AS ru FROM u4 WINDOW c AS (ORDER BY time ROWS UNBOUNDED PRECEDING)) SELECT round(max(dd), 3) AS max_drawdown, round(max(ru), 3) AS max_runup FROM u5",
    )


