"""Set-at-a-time backtests: market orders from signals, filled at the next bar's open, without a sequential kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.na import div
from barframe.operators.frames import KEYS, Keys


def positions(bars: DataFrame, enter: str, leave: str, k: Keys = KEYS) -> DataFrame:
    """``bars`` with ``position`` (1 or 0 held from this bar's open): long on ``enter``, flat on ``leave``, filled one bar later."""
    signal = F.when(F.col(enter), 1).when(F.col(leave), 0)
    wish = F.last(signal, ignorenulls=True).over(k.upto())
    staged = bars.withColumn("_wish", F.coalesce(wish, F.lit(0)))
    return staged.withColumn("position", F.coalesce(F.lag("_wish").over(k.bars()), F.lit(0))).drop("_wish")


def trades(held: DataFrame, qty: float = 1.0, k: Keys = KEYS) -> DataFrame:
    """One row per closed position: entry and exit at the opens where the position changes."""
    turn = F.col("position") != F.coalesce(F.lag("position").over(k.bars()), F.lit(0))
    staged = held.withColumn("_i", k.index()).withColumn("_turn", turn)
    staged = staged.where("_turn").withColumn("_exit", F.struct(F.lead("open").over(k.bars()).alias("price"), F.lead("time").over(k.bars()).alias("time"), F.lead("_i").over(k.bars()).alias("bar")))
    closed = staged.where((F.col("position") == 1) & F.col("_exit.time").isNotNull())
    profit = (F.col("_exit.price") - F.col("open")) * qty
    w = Window.partitionBy(*k.by).orderBy(*k.order).rowsBetween(Window.unboundedPreceding, 0)
    return closed.select(
        *k.by, F.col("time").alias("entry_time"), F.col("_exit.time").alias("exit_time"), F.col("_i").alias("entry_bar"), F.col("_exit.bar").alias("exit_bar"),
        F.col("open").alias("entry_price"), F.col("_exit.price").alias("exit_price"), F.lit(qty).alias("qty"), profit.alias("profit"), F.sum(profit).over(w).alias("cum_profit"),
    )


def equity(held: DataFrame, capital: float, qty: float = 1.0, k: Keys = KEYS) -> DataFrame:
    """Mark-to-market at every close: the position's moves from open to close and from close to open."""
    before = F.coalesce(F.lag("position").over(k.bars()), F.lit(0))
    night = F.coalesce(before * (F.col("open") - F.lag("close").over(k.bars())), F.lit(0.0))
    gain = night + F.col("position") * (F.col("close") - F.col("open"))
    return held.withColumn("_gain", gain).withColumn("equity", F.lit(capital) + qty * F.sum("_gain").over(k.upto())).drop("_gain")


def trade_metrics(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, gross and net profit, averages, expectancy and extremes by symbol."""
    p = F.col("profit")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    return ledger.groupBy(*(by or ["symbol"])).agg(
        F.count(F.lit(1)).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), (F.count(F.lit(1)) - F.count(win) - F.count(loss)).alias("evens"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("gross_loss"), F.sum(p).alias("net_profit"),
        F.avg(p).alias("avg_trade"), F.avg(win).alias("avg_win"), F.avg(-loss).alias("avg_loss"), div(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.max(win).alias("largest_win"), F.max(-loss).alias("largest_loss"), F.avg(F.col("exit_bar") - F.col("entry_bar")).alias("avg_bars"),
    )


def streaks(ledger: DataFrame) -> DataFrame:
    """The longest runs of wins and of losses by symbol (gaps and islands)."""
    w = Window.partitionBy("symbol").orderBy("exit_time", "entry_time")
    s = F.signum("profit")
    island = F.sum((s != F.coalesce(F.lag(s).over(w), F.lit(9.0))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = ledger.withColumn("_sign", s).withColumn("_island", island).groupBy("symbol", "_island", "_sign").count()
    longest = lambda v: F.coalesce(F.max(F.when(F.col("_sign") == v, F.col("count"))), F.lit(0))
    return runs.groupBy("symbol").agg(longest(1).alias("max_wins"), longest(-1).alias("max_losses"))


def equity_metrics(curve: DataFrame, periods_per_year: float, risk_free: float = 0.0, k: Keys = KEYS) -> DataFrame:
    """Sharpe, Sortino, volatility, exposure and the largest draw-down and run-up of an equity curve, close to close."""
    before = F.lag("equity").over(k.bars())
    peak, trough = F.max("equity").over(k.upto()), F.min("equity").over(k.upto())
    staged = curve.select(
        *k.by, "equity", (div(F.col("equity"), before) - 1).alias("r"), (peak - F.col("equity")).alias("dd"), (F.col("equity") - trough).alias("ru"),
        (F.col("position") != 0).cast("double").alias("in"),
    )
    root = float(periods_per_year) ** 0.5
    down = F.sqrt(F.avg(F.when(F.col("r") < -FLAT, F.col("r") * F.col("r"))))  # over the negative returns alone
    return staged.groupBy(*k.by).agg(
        (div(F.avg("r") - risk_free / periods_per_year, F.stddev_pop("r")) * root).alias("sharpe"), (div(F.avg("r") - risk_free / periods_per_year, down) * root).alias("sortino"),
        (F.stddev_pop("r") * root).alias("volatility"), F.max("dd").alias("max_drawdown"), F.max("ru").alias("max_runup"), F.avg("in").alias("exposure"),
    )


YEAR_SECONDS = 365.25 * 86_400
FLAT = 1e-12  # returns nearer to 0 are rounding


def periods_per_year(curve: DataFrame, timeframe_seconds: float | None = None, given: float | None = None, k: Keys = KEYS) -> DataFrame:
    """By symbol: ``years`` that the curve spans and ``ppy``: the given figure, else bars per year as they came, else those of the timeframe around the clock, else 252."""
    t = F.unix_micros(F.col("time").cast("timestamp")) / 1e6
    years = (F.max(t) - F.min(t)) / YEAR_SECONDS
    n = F.count("equity")
    chain = [F.lit(float(given))] if given and given > 0 else [F.when((years > 0) & (n > 1), (n - 1) / years)]
    chain += [F.lit(YEAR_SECONDS / timeframe_seconds)] if timeframe_seconds else []
    return curve.groupBy(*k.by).agg(years.alias("years"), F.coalesce(*chain, F.lit(252.0)).alias("ppy"), n.alias("bars"))


def phases(curve: DataFrame, k: Keys = KEYS) -> DataFrame:
    """Mean size and days of the close-to-close run-ups and draw-downs of an equity curve, by symbol.

    A bar at or above the peak so far is dry, any other under water. A draw-down goes from a dry bar over its trough to the next dry
    bar; a run-up from the trough before (at first the curve's beginning) to the dry bar at which water comes or the curve ends.
    """
    days = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 86_400e6
    peak = F.max("equity").over(k.upto().rowsBetween(Window.unboundedPreceding, -1))
    dry = F.coalesce(F.col("equity") >= peak, F.lit(True))
    marked = curve.select(*k.by, "time", "equity", dry.alias("_dry")).withColumn("_island", F.sum(F.col("_dry").cast("int")).over(k.upto()))
    wet = lambda x: F.when(~F.col("_dry"), x)
    low = F.min(wet(F.struct("equity", "time")))
    islands = marked.groupBy(*k.by, "_island").agg(
        F.max(F.when(F.col("_dry"), F.col("equity"))).alias("top"), F.max(F.when(F.col("_dry"), F.col("time"))).alias("at"), low["equity"].alias("low"), low["time"].alias("low_at"),
    )
    w = Window.partitionBy(*k.by).orderBy("_island")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    staged = islands.select(
        *k.by, "top", "at", "low", F.lead("at").over(w).alias("_next"), F.coalesce(F.last("low", True).over(before), F.first("top").over(first)).alias("_from"),
        F.coalesce(F.last("low_at", True).over(before), F.first("at").over(first)).alias("_since"),
    )
    down = F.col("low").isNotNull() & F.col("_next").isNotNull()
    up = (F.col("low").isNotNull() | F.col("_next").isNull()) & (F.col("top") > F.col("_from"))
    mean = lambda ok, x: F.coalesce(F.avg(F.when(ok, x)), F.lit(0.0))
    return staged.groupBy(*k.by).agg(
        mean(up, F.col("top") - F.col("_from")).alias("avg_runup"), mean(up, days("_since", "at")).alias("avg_runup_days"),
        mean(down, F.col("top") - F.col("low")).alias("avg_drawdown"), mean(down, days("at", "_next")).alias("avg_drawdown_days"),
    )


def strategy_report(curve: DataFrame, ledger: DataFrame, capital: float, timeframe_seconds: float | None = None, given: float | None = None, risk_free: float = 0.0, k: Keys = KEYS) -> DataFrame:
    """One row of metrics per symbol of a curve (bars with equity and position) and its closed trades; ratios without a denominator are 0, infinite ones na.

    Draw-down percentages are close to close. Buying and holding begins at the price of the first trade, else at the second bar's open.
    """
    basis = periods_per_year(curve, timeframe_seconds, given, k)
    before = F.lag("equity").over(k.bars())
    peak, trough = F.max("equity").over(k.upto()), F.min("equity").over(k.upto())
    staged = curve.withColumn("_i", F.row_number().over(k.bars())).select(
        *k.by, "time", "open", "close", "equity", "_i", (div(F.col("equity"), before) - 1).alias("r"), (peak - F.col("equity")).alias("dd"), (100 * div(peak - F.col("equity"), peak)).alias("ddp"), (F.col("equity") - trough).alias("ru"), (F.col("position") != 0).cast("double").alias("in"),
    )
    bars = staged.groupBy(*k.by).agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.sqrt(F.avg(F.when(F.col("r") < -FLAT, F.col("r") * F.col("r")))).alias("down"), F.max("dd").alias("max_drawdown"), F.max("ddp").alias("max_drawdown_percent"), F.max("ru").alias("max_runup"),
        F.avg("in").alias("in"), F.max_by("equity", "time").alias("final"), F.max(F.when(F.col("_i") == 2, F.col("open"))).alias("second"), F.max_by("close", "time").alias("last"), F.min_by("close", "time").alias("only"),
    )
    held = F.col("exit_bar") - F.col("entry_bar")
    p = F.col("profit")
    win, loss = p > 0, p < 0
    trades = ledger.groupBy(*k.by).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(p).alias("net"), F.sum(F.when(win, p)).alias("won"), F.sum(F.when(loss, -p)).alias("lost"), F.max(F.when(win, p)).alias("best"), F.max(F.when(loss, -p)).alias("worst"), F.avg(F.when(win, p)).alias("mean_win"), F.avg(F.when(loss, -p)).alias("mean_loss"),
        F.avg(held).alias("held"), F.avg(F.when(win, held)).alias("held_win"), F.avg(F.when(loss, held)).alias("held_loss"), F.min_by("entry_price", "entry_bar").alias("first_price"),
    )
    x = F.col
    nought = lambda c: F.coalesce(c, F.lit(0.0))
    root = F.sqrt("ppy")
    excess = x("mean") - risk_free / x("ppy")
    cagr_years = F.when(x("years") > 0, x("years")).otherwise(F.when(x("bars") > 1, x("bars") / x("ppy")))
    cagr = nought(F.when((cagr_years > 0) & (x("final") > 0), (F.pow(x("final") / capital, 1 / cagr_years) - 1) * 100))
    base = F.coalesce(F.when(x("first_price") > 0, x("first_price")), x("second"), x("only"))
    hold = nought(F.when(base > 0, x("last") / base - 1))
    net = nought(x("net"))
    return basis.join(bars, list(k.by)).join(phases(curve, k), list(k.by)).join(trades, list(k.by), "left").select(
        *k.by, x("ppy").alias("periods_per_year"), nought(div(excess, x("sd")) * root).alias("sharpe"), F.coalesce(div(excess, x("down")) * root, F.when(excess <= 0, 0.0)).alias("sortino"), (x("sd") * root * 100).alias("volatility_percent"),
        cagr.alias("cagr_percent"), nought(div(cagr, x("max_drawdown_percent"))).alias("calmar"), (100 * x("in")).alias("exposure_percent"), nought(div(net, x("trades"))).alias("expectancy"),
        nought(x("best")).alias("largest_win"), (-nought(x("worst"))).alias("largest_loss"), nought(x("held")).alias("avg_bars_in_trade"), nought(x("held_win")).alias("avg_bars_in_winners"), nought(x("held_loss")).alias("avg_bars_in_losers"),
        nought(div(x("mean_win"), x("mean_loss"))).alias("avg_win_loss_ratio"), nought(100 * div(x("best"), x("won"))).alias("largest_win_percent_of_gross_profit"), nought(100 * div(x("worst"), x("lost"))).alias("largest_loss_percent_of_gross_loss"),
        nought(100 * div(net, x("worst"))).alias("net_profit_percent_of_largest_loss"), (100 * net / capital).alias("return_on_capital_percent"), (100 * hold).alias("buy_hold_return_percent"), (capital * hold).alias("buy_hold_pnl"), (net - capital * hold).alias("outperformance"),
        (100 * x("max_runup") / capital).alias("max_runup_percent_of_capital"), (100 * x("max_drawdown") / capital).alias("max_drawdown_percent_of_capital"), "max_runup", "max_drawdown", "max_drawdown_percent", "avg_runup", "avg_drawdown", "avg_runup_days", "avg_drawdown_days",
    )


def weighted_sleeves(curves: DataFrame, weights: dict[str, float], capital: float) -> DataFrame:
    """Curves of sleeves that each had all the capital, scaled to their share of it; weights are normalised and must be positive."""
    if not weights or any(not x > 0 for x in weights.values()) or not capital > 0:
        raise ValueError("a portfolio needs symbols with positive weights and a positive capital")
    total = sum(weights.values())
    share = F.create_map(*[y for s, x in weights.items() for y in (F.lit(s), F.lit(x / total))])
    return curves.where(F.col("symbol").isin(*weights)).withColumn("equity", F.col("equity") * share[F.col("symbol")])


def portfolio_equity(curves: DataFrame, weights: dict[str, float], capital: float) -> DataFrame:
    """time, equity of isolated sleeves on the union of their clocks, each with its share of the capital."""
    total = sum(weights.values())
    scaled = weighted_sleeves(curves, weights, capital)
    share = F.create_map(*[y for s, x in weights.items() for y in (F.lit(s), F.lit(capital * x / total))])
    w = Window.partitionBy("symbol").orderBy("time")
    step = F.col("equity") - F.coalesce(F.lag("equity").over(w), share[F.col("symbol")])
    per_time = scaled.withColumn("_step", step).groupBy("time").agg(F.sum("_step").alias("_step"))
    return running_total(per_time, "time", "_step", "_gain").select("time", (F.col("_gain") + F.lit(float(capital))).alias("equity"))


def portfolio_extremes(curve: DataFrame, width: str = "MONTH") -> DataFrame:
    """The largest close-to-close draw-down and run-up of one portfolio curve: extremes of blocks first, then of the blocks, no window over all rows."""
    block = F.date_trunc(width, F.col("time").cast("timestamp"))
    inside = Window.partitionBy("_block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    staged = curve.withColumn("_block", block)
    ends = staged.groupBy("_block").agg(F.max("equity").alias("_hi"), F.min("equity").alias("_lo"))
    ends = ends.select("_block", F.max("_hi").over(over).alias("_hi"), F.min("_lo").over(over).alias("_lo"))
    peak, trough = F.greatest(F.max("equity").over(inside), F.col("_hi")), F.least(F.min("equity").over(inside), F.col("_lo"))
    got = staged.join(ends, "_block").select((peak - F.col("equity")).alias("dd"), (F.col("equity") - trough).alias("ru"))
    return got.agg(F.max("dd").alias("max_drawdown"), F.max("ru").alias("max_runup"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """The return of buying each symbol's second open and holding to its last close."""
    w = Window.partitionBy("symbol").orderBy("time")
    second = bars.withColumn("_n", F.row_number().over(w))
    return second.groupBy("symbol").agg(
        F.max(F.when(F.col("_n") == 2, F.col("open"))).alias("entry_price"), F.max_by("close", "time").alias("exit_price"),
    ).withColumn("return", div(F.col("exit_price"), F.col("entry_price")) - 1)


def union_clock(curves: DataFrame, capital: float) -> DataFrame:
    """Portfolio equity on the union of all clocks: each sleeve stands still between its bars and at its capital before them.

    Each sleeve contributes its changes, so the sum is one running total over the times: no sleeve is spread over the clock.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    step = F.col("equity") - F.coalesce(F.lag("equity").over(w), F.lit(capital))
    per_time = curves.withColumn("_step", step).groupBy("time").agg(F.sum("_step").alias("_step"))
    sleeves = curves.select(F.countDistinct("symbol").alias("_sleeves"))
    total = running_total(per_time, "time", "_step", "_gain")
    return total.join(F.broadcast(sleeves), F.lit(True)).select("time", (F.col("_gain") + F.col("_sleeves") * F.lit(capital)).alias("equity"))


def running_total(df: DataFrame, order: str, x: str, out: str, width: str = "MONTH") -> DataFrame:
    """A running total over all rows without one task for them: totals within calendar blocks, then over the blocks."""
    block = F.date_trunc(width, F.col(order).cast("timestamp"))
    staged = df.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged.groupBy("_block").agg(F.sum(x).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0.0))).select("_block", "_before")
    return staged.withColumn("_inside", F.sum(x).over(inside)).join(sums, "_block").withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_block")


def merged_ledger(ledger: DataFrame) -> DataFrame:
    """All sleeves' trades by exit time, ties by symbol and entry, with the portfolio's running profit."""
    per_time = running_total(ledger.groupBy("exit_time").agg(F.sum("profit").alias("_p")), "exit_time", "_p", "_upto").select("exit_time", (F.col("_upto") - F.col("_p")).alias("_before"))
    w = Window.partitionBy("exit_time").orderBy("symbol", "entry_time").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("_in", F.sum("profit").over(w)).join(per_time, "exit_time").withColumn("portfolio_profit", F.col("_before") + F.col("_in")).drop("_in", "_before")
