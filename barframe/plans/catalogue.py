"""The registered queries over the bar tables, each with its SQL."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.functions import arrays as A
from barframe.functions import maps as M
from barframe.functions import matrices as X
from barframe.functions import scalar as S
from barframe.na import div, eq, ge, gt, le, lt, mod, ne, nz, to_int
from barframe.operators import broker as B
from barframe.operators import drawings as D
from barframe.operators import recursive as R
from barframe.operators import security as Q
from barframe.operators import signals as G
from barframe.operators import ta, timeframe
from barframe.plans.programs import bracket_program, cross_program
from barframe.plans.script_queries import register_all
from barframe.sources.bars import event_bars, order_bars
from barframe.streaming import bars as S2

Query = Callable[[SparkSession, str], DataFrame]
#: What ``_build`` fills. Expressions need a session, so building waits for the first call; names and SQL lie in a file beside
#: this module, which ``python -m barframe.plans.catalogue`` writes anew.
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
STORED = Path(__file__).with_name("catalogue.json")

BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS pc FROM bars)"""
W = "(PARTITION BY symbol ORDER BY time)"


def frame(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


CUM = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6) + 0.0


def q6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0"


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def bars_query(name: str, doubles: dict[str, tuple[Column, str]], others: dict[str, tuple[Column, str]] | None = None, ctes: str = "", source: str = "b", prepare: Callable | None = None) -> None:
    """A query of columns over the hourly bars: name -> (expression, SQL); ``doubles`` are rounded to six places."""
    others = others or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = event_bars(spark, sf_dir)
        df = prepare(df) if prepare else df
        return df.select("symbol", "time", *[r6(c).alias(n) for n, (c, _) in doubles.items()], *[c.alias(n) for n, (c, _) in others.items()])

    cols = [f"{q6(s)} AS {n}" for n, (_, s) in doubles.items()] + [f"{s} AS {n}" for n, (_, s) in others.items()]
    register(name, run, f"WITH RECURSIVE {BARS}{ctes} SELECT symbol, time, {', '.join(cols)} FROM {source}")


def full(n: int, x: str) -> str:
    """x once there are n bars."""
    return f"CASE WHEN i >= {n} THEN {x} END"


def wsum(x: str, weights: list[float]) -> str:
    """The last bars times weights, oldest first."""
    n = len(weights)
    return "+".join(f"{w}::DOUBLE*lag({x},{n - 1 - k}) OVER {W}" if k < n - 1 else f"{w}::DOUBLE*{x}" for k, w in enumerate(weights))



def marked(d: DataFrame) -> DataFrame:
    """Bars with the crosses of two moving averages."""
    staged = d.withColumn("f", F.round(ta.sma("close", 5), 8)).withColumn("s", F.round(ta.sma("close", 20), 8))
    return staged.withColumn("up", ta.crossover("f", "s")).withColumn("down", ta.crossunder("f", "s")).drop("f", "s")


def _build() -> None:
    c, h, lo, o, v = (F.col(x) for x in ("close", "high", "low", "open", "volume"))
    # --- sources and resampling
    ohlcv = {n: (F.col(n), n) for n in ("open", "high", "low", "close", "volume")}
    bars_query("ohlcv_1h", ohlcv)
    register(
        "ohlcv_1d_orders", lambda s, d: order_bars(s, d).select("symbol", "time", *[r6(F.col(x)).alias(x) for x in ohlcv]),
        f"""SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS time, {q6('first(o_totalprice ORDER BY o_orderdate, o_orderkey)')} AS open, {q6('max(o_totalprice)')} AS high, {q6('min(o_totalprice)')} AS low,
        {q6('last(o_totalprice ORDER BY o_orderdate, o_orderkey)')} AS close, {q6('count(*)')} AS volume FROM orders GROUP BY o_orderpriority, date_trunc('day', o_orderdate)""",
    )
    bucket_sql = {
        "resample_4h": ("240", "floor(epoch(time) / 14400)::BIGINT"), "resample_1d": ("1D", "floor(epoch(time) / 86400)::BIGINT"),
        "resample_1w_monday": ("1W", "floor((floor(epoch(time) / 86400) + 3) / 7)::BIGINT"), "resample_1mo": ("1M", "(year(time) * 12 + month(time) - 1)::BIGINT"),
    }
    for name, (tf, sql) in bucket_sql.items():
        register(
            name, lambda s, d, tf=tf: Q.resample(event_bars(s, d), tf).select("symbol", "time", "bucket", *[r6(F.col(x)).alias(x) for x in ohlcv]),
            f"""WITH {BARS} SELECT symbol, min(time) AS time, {sql} AS bucket, {q6('arg_min(open, time)')} AS open, {q6('max(high)')} AS high, {q6('min(low)')} AS low, {q6('arg_max(close, time)')} AS close, {q6('sum(volume)')} AS volume FROM b GROUP BY symbol, {sql}""",
        )
    bars_query("hl2_family", {"hl2": (ta.hl2(), "(high+low)/2"), "hlc3": (ta.hlc3(), "(high+low+close)/3"), "ohlc4": (ta.ohlc4(), "(open+high+low+close)/4"), "hlcc4": (ta.hlcc4(), "(high+low+2*close)/4")})
    # --- valid-row windows
    bars_query("sma", {f"sma{n}": (ta.sma("close", n), full(n, f"avg(close) OVER {frame(n)}")) for n in (5, 20)})
    bars_query("rolling_sum", {"s": (ta.sum_("close", 10), full(10, f"sum(close) OVER {frame(10)}"))})
    bars_query("stdev", {"x": (ta.stdev("close", 20), full(20, f"stddev_pop(close) OVER {frame(20)}"))})
    bars_query("variance", {"x": (ta.variance("close", 20), full(20, f"var_pop(close) OVER {frame(20)}"))})
    bars_query("median", {"x": (ta.median("close", 9), full(9, f"median(close) OVER {frame(9)}"))})
    bars_query("range", {"x": (ta.range_("close", 9), full(9, f"max(close) OVER {frame(9)} - min(close) OVER {frame(9)}"))})
    bars_query("wma", {"x": (ta.wma("close", 9), full(9, f"({wsum('close', list(range(1, 10)))})/45"))})
    al = [math.exp(-((k - 0.85 * 8) ** 2) / (2 * (9 / 6) ** 2)) for k in range(9)]
    bars_query("alma", {"x": (ta.alma("close", 9), full(9, f"({wsum('close', al)})/{sum(al)}::DOUBLE"))})
    bars_query("swma", {"x": (ta.swma("close"), full(4, f"({wsum('close', [1, 2, 2, 1])})/6"))})
    bars_query("cog", {"x": (ta.cog("close", 10), full(10, f"-({wsum('close', list(range(10, 0, -1)))})/(sum(close) OVER {frame(10)})"))})
    bars_query(
        "hma", {"x": (ta.hma("close", 9), full(11, f"({wsum('d', [1, 2, 3])})/6"))},
        ctes=f", h1 AS (SELECT *, 2*({wsum('close', [1, 2, 3, 4])})/10 - ({wsum('close', list(range(1, 10)))})/45 AS d FROM b)", source="h1",
    )
    bars_query("vwma", {}, {"x": (F.round(ta.vwma("close", 10), 9), full(10, f"round(sum(close*volume) OVER {frame(10)} / sum(volume) OVER {frame(10)}, 9)"))})
    dev_cte = f", d1 AS (SELECT *, avg(close) OVER {frame(10)} AS m, list(close) OVER {frame(10)} AS vs FROM b), d2 AS (SELECT *, list_sum(list_transform(vs, lambda z: abs(z - m))) / 10 AS dev FROM d1)"
    bars_query("dev", {"x": (ta.dev("close", 10), full(10, "dev"))}, ctes=dev_cte, source="d2")
    bars_query("cci", {"x": (ta.cci("close", 10), full(10, "CASE WHEN dev = 0 THEN 0 ELSE (close - m) / (0.015::DOUBLE * dev) END"))}, ctes=dev_cte, source="d2")
    sd, mean = f"stddev_pop(close) OVER {frame(20)}", f"avg(close) OVER {frame(20)}"
    bb = ta.bb("close", 20, 2.0)
    bars_query("bb", {"basis": (bb["basis"], full(20, mean)), "upper": (bb["upper"], full(20, f"{mean} + 2*{sd}")), "lower": (bb["lower"], full(20, f"{mean} - 2*{sd}")), "width": (ta.bbw("close", 20, 2.0), full(20, f"4*{sd}/({mean})"))})
    bars_query("linreg", {f"x{k}": (ta.linreg("close", 14, k), full(14, f"avg(close) OVER {frame(14)} + covar_pop(close, i) OVER {frame(14)} / var_pop(i) OVER {frame(14)} * (i - {k} - avg(i) OVER {frame(14)})")) for k in (0, 2)})
    bars_query("correlation", {"x": (ta.correlation("close", "open", 14), full(14, f"covar_pop(close, open) OVER {frame(14)} / nullif(stddev_pop(close) OVER {frame(14)} * stddev_pop(open) OVER {frame(14)}, 0)"))})
    up, dn = f"sum(greatest(close-pc,0)) OVER {frame(9)}", f"sum(greatest(pc-close,0)) OVER {frame(9)}"
    bars_query("cmo", {"x": (ta.cmo("close", 9), full(10, f"CASE WHEN {up}+{dn}=0 THEN 0 ELSE 100*({up}-{dn})/({up}+{dn}) END"))})
    mf = ", m1 AS (SELECT *, (high+low+close)/3 AS tp, lag((high+low+close)/3) OVER " + W + " AS tpp FROM b)"
    mp, mn = f"sum(CASE WHEN tp>tpp THEN tp*volume ELSE 0 END) OVER {frame(14)}", f"sum(CASE WHEN tp<tpp THEN tp*volume ELSE 0 END) OVER {frame(14)}"
    bars_query("mfi", {"x": (ta.mfi("tp", 14), full(15, f"CASE WHEN {mn}=0 THEN 100 ELSE 100-100/(1+{mp}/{mn}) END"))}, ctes=mf, source="m1", prepare=lambda d: d.withColumn("tp", ta.hlc3()))
    bars_query("ao", {"x": (ta.ao(), full(34, f"avg((high+low)/2) OVER {frame(5)} - avg((high+low)/2) OVER {frame(34)}"))})
    bars_query("rci", {"x": (ta.rci("close", 6), full(6, "CASE WHEN v*17.5=0 THEN 0 ELSE 100*c/sqrt(v*17.5::DOUBLE) END"))}, source="r3", ctes=f""", r1 AS (SELECT *, list(close) OVER {frame(6)} AS vs FROM b),
      r2 AS (SELECT *, list_transform(vs, lambda z: len(list_filter(vs, lambda u: u < z)) + (len(list_filter(vs, lambda u: u = z)) + 1) / 2.0::DOUBLE - 3.5::DOUBLE) AS rk FROM r1),
      r3 AS (SELECT *, list_sum(list_transform(rk, lambda z, n: z * (n - 3.5::DOUBLE))) AS c, list_sum(list_transform(rk, lambda z: z * z)) AS v FROM r2)""")
    bars_query("mode", {"x": (ta.mode("x", 8), full(8, "list_sort(list_filter(list_distinct(xs), lambda u: len(list_filter(xs, lambda z: z = u)) = list_max(list_transform(xs, lambda z: len(list_filter(xs, lambda y: y = z))))))[1]"))},
      ctes=f", o1 AS (SELECT *, list(floor(close/20)) OVER {frame(8)} AS xs FROM b)", source="o1", prepare=lambda d: d.withColumn("x", F.floor(F.col("close") / 20).cast("double")))
    nulls = lambda d: d.withColumn("x", F.when(F.col("volume") > 1, F.col("close")))
    vframe = "(PARTITION BY symbol, x IS NULL ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    bars_query("sma_with_nulls", {"x": (ta.sma("x", 5), f"CASE WHEN x IS NOT NULL AND count(x) OVER {vframe} = 5 THEN avg(x) OVER {vframe} END")}, ctes=", n1 AS (SELECT *, CASE WHEN volume > 1 THEN close END AS x FROM b)", source="n1", prepare=nulls)
    # --- bar windows
    bars_query("highest_lowest", {"hi": (ta.highest("high", 10), full(10, f"max(high) OVER {frame(10)}")), "lo": (ta.lowest("low", 10), full(10, f"min(low) OVER {frame(10)}"))})
    bars_query("highestbars_lowestbars", {}, {"hi": (ta.highestbars("high", 10).cast("long"), full(10, f"(arg_max(i, {{'x': high, 'i': i}}) OVER {frame(10)} - i)::BIGINT")), "lo": (ta.lowestbars("low", 10).cast("long"), full(10, f"(arg_min(i, {{'x': low, 'i': -i}}) OVER {frame(10)} - i)::BIGINT"))})
    bars_query("percentile_nearest_rank", {"x": (ta.percentile_nearest_rank("close", 10, 75), full(10, f"list_sort(list(close) OVER {frame(10)})[8]"))})
    bars_query("percentile_linear", {"x": (ta.percentile_linear_interpolation("close", 10, 40), full(10, f"list_sort(list(close) OVER {frame(10)})[4] + 0.5::DOUBLE*(list_sort(list(close) OVER {frame(10)})[5] - list_sort(list(close) OVER {frame(10)})[4])"))})
    bars_query("stoch", {"x": (ta.stoch("close", "high", "low", 14), full(14, f"100*(close - min(low) OVER {frame(14)})/nullif(max(high) OVER {frame(14)} - min(low) OVER {frame(14)},0)"))})
    bars_query("wpr", {"x": (ta.wpr(14), full(14, f"-100*(max(high) OVER {frame(14)} - close)/nullif(max(high) OVER {frame(14)} - min(low) OVER {frame(14)},0)"))})
    bars_query("percentrank", {"x": (ta.percentrank("close", 10), full(11, f"100.0::DOUBLE*len(list_filter(vs, lambda z: z <= close))/10"))}, ctes=f", p1 AS (SELECT *, list(close) OVER {frame(10, 1)} AS vs FROM b)", source="p1")
    steps = lambda op: full(4, f"min(CASE WHEN close {op} pc THEN 1 ELSE 0 END) OVER {frame(3)} = 1")
    bars_query("rising_falling", {}, {"up": (ta.rising("close", 3), f"coalesce({steps('>')}, false)"), "down": (ta.falling("close", 3), f"coalesce({steps('<')}, false)")})
    ph = f"lag(high, 2) OVER {W}"
    pl = f"lag(low, 2) OVER {W}"
    bars_query("pivot_high_low", {
        "ph": (ta.pivothigh("high", 3, 2), full(6, f"CASE WHEN {ph} > max(high) OVER {frame(3, 3)} AND {ph} > max(high) OVER {frame(2)} THEN {ph} END")),
        "pl": (ta.pivotlow("low", 3, 2), full(6, f"CASE WHEN {pl} < min(low) OVER {frame(3, 3)} AND {pl} < min(low) OVER {frame(2)} THEN {pl} END")),
    })
    # --- lags and crosses
    bars_query("change_mom_roc", {"ch": (ta.change("close", 1), "close-pc"), "mom": (ta.mom("close", 5), f"close - lag(close,5) OVER {W}"), "roc": (ta.roc("close", 5), f"100*(close - lag(close,5) OVER {W})/nullif(lag(close,5) OVER {W},0)")})
    bars_query("history_offset", {"x3": (F.lag("close", 3).over(ta.KEYS.bars()), f"lag(close,3) OVER {W}"), "h1": (F.lag("high", 1).over(ta.KEYS.bars()), f"lag(high,1) OVER {W}")})
    cross_cte = f", s1 AS (SELECT *, CASE WHEN i>=5 THEN round(avg(close) OVER {frame(5)}, 8) END AS f, CASE WHEN i>=20 THEN round(avg(close) OVER {frame(20)}, 8) END AS s FROM b), s2 AS (SELECT *, lag(f) OVER {W} AS pf, lag(s) OVER {W} AS ps FROM s1)"
    smas = lambda d: d.withColumn("f", F.round(ta.sma("close", 5), 8)).withColumn("s", F.round(ta.sma("close", 20), 8))
    over, under = "coalesce(pf<=ps AND f>s,false)", "coalesce(pf>=ps AND f<s,false)"
    bars_query("cross_family", {}, {"over": (ta.crossover("f", "s"), over), "under": (ta.crossunder("f", "s"), under), "any_cross": (ta.cross("f", "s"), f"({over} OR {under})")}, ctes=cross_cte, source="s2", prepare=smas)
    tr1 = "CASE WHEN pc IS NULL THEN high-low ELSE greatest(high-low, abs(high-pc), abs(low-pc)) END"
    bars_query("tr", {"x": (ta.tr(), f"CASE WHEN pc IS NOT NULL THEN {tr1} END"), "y": (ta.tr(True), tr1)})
    # --- cumulative
    bars_query("cum_max_min", {"s": (ta.cum("close"), f"sum(close) OVER {CUM}"), "hi": (ta.max_("close"), f"max(close) OVER {CUM}"), "lo": (ta.min_("close"), f"min(close) OVER {CUM}")})
    bars_query("barssince", {}, {"n": (ta.barssince(F.col("close") > F.col("open")).cast("long"), f"i - max(CASE WHEN close>open THEN i END) OVER {CUM}")})
    bars_query("valuewhen", {"x0": (ta.valuewhen(c > o, "high", 0), f"last_value(CASE WHEN close>open THEN high END IGNORE NULLS) OVER {CUM}"), "x1": (ta.valuewhen(c > o, "high", 1), "last_value(h2 IGNORE NULLS) OVER " + CUM)},
      ctes=", v1 AS (SELECT *, CASE WHEN close>open THEN lag(high) OVER (PARTITION BY symbol, close>open ORDER BY time) END AS h2 FROM b)", source="v1")
    bars_query("fixnan_nz", {"f": (ta.fixnan("x"), f"last_value(x IGNORE NULLS) OVER {CUM}"), "z": (nz("x", -1.0), "coalesce(x,-1)")}, ctes=", n1 AS (SELECT *, CASE WHEN volume > 1 THEN close END AS x FROM b)", source="n1", prepare=nulls)
    clv = "CASE WHEN high=low THEN 0 ELSE ((close-low)-(high-close))/nullif(high-low,0)*volume END"
    bars_query("obv_accdist_pvt", {"obv": (ta.obv(), f"coalesce(sum(sign(close-pc)*volume) OVER {CUM},0)"), "ad": (ta.accdist(), f"sum({clv}) OVER {CUM}"), "pvt": (F.round(ta.pvt(), 4), f"round(coalesce(sum((close-pc)/nullif(pc,0)*volume) OVER {CUM},0)::DOUBLE, 4)")})
    ratio = lambda op: f"product(CASE WHEN volume {op} pv AND close<>0 AND pc<>0 THEN close/nullif(pc,0) ELSE 1 END) OVER {CUM}"
    sig = lambda x: F.round(F.log10(F.greatest(x, F.lit(1e-290))), 4)
    bars_query("nvi_pvi", {"nvi": (sig(ta.nvi()), f"round(log10(greatest({ratio('<')},1e-290)),4)"), "pvi": (sig(ta.pvi()), f"round(log10(greatest({ratio('>')},1e-290)),4)")}, ctes=f", v1 AS (SELECT *, lag(volume) OVER {W} AS pv FROM b)", source="v1")
    bars_query("wad_iii_wvad", {
        "wad": (ta.wad(), f"sum(CASE WHEN close>pc THEN close-least(pc,low) WHEN close<pc THEN close-greatest(pc,high) ELSE 0 END) OVER {CUM}"),
        "iii": (ta.iii(), "CASE WHEN (high-low)*volume=0 THEN 0 ELSE (2*close-high-low)/nullif((high-low)*volume,0) END"),
        "wvad": (ta.wvad(), "CASE WHEN high=low THEN 0 ELSE (close-open)/nullif(high-low,0)*volume END"),
    })
    ud = ta.up_and_down_volume()
    bars_query("up_down_volume", {"up": (ud["up"], "CASE WHEN close>open THEN volume ELSE 0 END"), "down": (ud["down"], "CASE WHEN close<open THEN -volume ELSE 0 END"), "delta": (ud["delta"], "CASE WHEN close>open THEN volume WHEN close<open THEN -volume ELSE 0 END")})
    day = "(PARTITION BY symbol, time::DATE ORDER BY time ROWS UNBOUNDED PRECEDING)"
    bars_query("vwap_session", {"x": (ta.vwap(ta.hlc3()), f"sum((high+low+close)/3*volume) OVER {day}/sum(volume) OVER {day}")})
    seg = "(PARTITION BY symbol, g ORDER BY time ROWS UNBOUNDED PRECEDING)"
    vb = ta.vwap("close", anchor=F.hour("time") == 12, mult=2.0)
    band = f"2*sqrt(greatest(0, sum(close*close*volume) OVER {seg}/sum(volume) OVER {seg} - (sum(close*volume) OVER {seg}/sum(volume) OVER {seg})**2))"
    vm = f"sum(close*volume) OVER {seg}/sum(volume) OVER {seg}"
    r4 = lambda x: F.round(x, 4)
    bars_query("vwap_anchored_bands", {"upper": (r4(vb["upper"]), f"round({vm}+{band},4)"), "lower": (r4(vb["lower"]), f"round({vm}-{band},4)")}, {"vwap": (F.round(vb["vwap"], 9), f"round({vm},9)")}, ctes=f", g1 AS (SELECT *, sum((hour(time)=12)::INT) OVER {CUM} AS g FROM b)", source="g1")
    piv_cte = f""", g1 AS (SELECT *, time::DATE AS d, lag(time::DATE) OVER {W} AS pd FROM b), g2 AS (SELECT *, sum((pd IS NULL OR d<>pd)::INT) OVER {CUM} AS g FROM g1),
      g3 AS (SELECT symbol, g, first(open ORDER BY time) AS po, max(high) AS ph, min(low) AS pl, last(close ORDER BY time) AS pcl FROM g2 GROUP BY symbol, g),
      g4 AS (SELECT g2.*, po, ph, pl, pcl, first_value(open) OVER (PARTITION BY g2.symbol, g2.g ORDER BY time ROWS UNBOUNDED PRECEDING) AS cur FROM g2 LEFT JOIN g3 ON g3.symbol=g2.symbol AND g3.g=g2.g-1)"""
    p = "(ph+pl+pcl)/3"
    rng = "(ph-pl)"
    levels = {
        "Traditional": [p, f"2*{p}-pl", f"2*{p}-ph", f"{p}+{rng}", f"{p}-{rng}", f"ph+2*({p}-pl)", f"pl-2*(ph-{p})", f"ph+3*({p}-pl)", f"pl-3*(ph-{p})", f"ph+4*({p}-pl)", f"pl-4*(ph-{p})"],
        "Fibonacci": [p, *[f"{p}{s}{k}::DOUBLE*{rng}" for k in (0.382, 0.618, 1.0) for s in "+-"]],
        "Woodie": ["(ph+pl+2*cur)/4", "2*(ph+pl+2*cur)/4-pl", "2*(ph+pl+2*cur)/4-ph"],
        "Classic": [p, f"2*{p}-pl", f"2*{p}-ph", f"{p}+{rng}", f"{p}-{rng}", f"{p}+2*{rng}", f"{p}-2*{rng}"],
        "DM": [f"(CASE WHEN pcl<po THEN ph+2*pl+pcl WHEN pcl>po THEN 2*ph+pl+pcl ELSE ph+pl+2*pcl END)/4"],
        "Camarilla": [p, *[f"pcl{s}{rng}*1.1::DOUBLE/{k}" for k in (12, 6, 4, 2) for s in "+-"]],
    }
    for kind, sqls in levels.items():
        col = ta.pivot_point_levels(kind, ta.new_day())
        bars_query(f"pivot_levels_{kind.lower()}", {f"l{n}": (F.get(col, F.lit(n)), s) for n, s in enumerate(sqls)}, ctes=piv_cte, source="g4")
    # --- recursive
    def recursive(name: str, calls: list[R.Call], outs: dict[str, str], ctes: str, source: str) -> None:
        bars_query(name, {n: (F.col(n), s) for n, s in outs.items()}, ctes=ctes, source=source, prepare=lambda d: R.with_recursive(d, calls))

    def rec(name: str, of: str, start: str, seeds: dict[str, str], steps: dict[str, str]) -> str:
        """A recursive table over the dense row number i of ``of``; ``e`` is the row before, ``b`` the row."""
        keys = list(seeds)
        return f", {name} AS (SELECT symbol, i, {', '.join(f'({seeds[k]})::DOUBLE AS {k}' for k in keys)} FROM {of} b WHERE {start} UNION ALL SELECT b.symbol, b.i, {', '.join(f'({steps[k]})::DOUBLE' for k in keys)} FROM {name} e JOIN {of} b ON b.symbol=e.symbol AND b.i=e.i+1)"

    def joined(name: str, of: str) -> str:
        return f", {name}j AS (SELECT {of}.*, {name}.* EXCLUDE (symbol, i) FROM {of} LEFT JOIN {name} USING (symbol, i))"

    def ema_step(k: str, n: int, x: str) -> str:
        return f"{2 / (n + 1)!r}::DOUBLE*({x}) + {1 - 2 / (n + 1)!r}::DOUBLE*e.{k}"

    recursive("ema", [R.Call(("x",), "ema", (10,), "close")], {"x": "x"}, rec("e1", "b", "b.i=1", {"x": "b.close"}, {"x": ema_step("x", 10, "b.close")}) + joined("e1", "b"), "e1j")
    f10 = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    rma_cte = f", a0 AS (SELECT *, avg(close) OVER {f10} AS m, {tr1} AS tr, avg({tr1}) OVER {f10} AS mtr FROM b)"
    recursive("rma", [R.Call(("x",), "rma", (10,), "close")], {"x": "x"}, rma_cte + rec("a1", "a0", "b.i=10", {"x": "b.m"}, {"x": "(e.x*9+b.close)/10"}) + joined("a1", "b"), "a1j")
    recursive("atr", [R.Call(("x",), "atr", (10,))], {"x": "x"}, rma_cte + rec("a1", "a0", "b.i=10", {"x": "b.mtr"}, {"x": "(e.x*9+b.tr)/10"}) + joined("a1", "b"), "a1j")
    ud_cte = f", a0 AS (SELECT *, greatest(close-pc,0) AS u, greatest(pc-close,0) AS d, avg(greatest(close-pc,0)) OVER {f10} AS mu, avg(greatest(pc-close,0)) OVER {f10} AS md FROM b)"
    recursive("rsi", [R.Call(("x",), "rsi", (10,), "close")], {"x": "CASE WHEN d1=0 THEN 100 ELSE 100-100/(1+u1/d1) END"}, ud_cte + rec("a1", "a0", "b.i=11", {"u1": "b.mu", "d1": "b.md"}, {"u1": "(e.u1*9+b.u)/10", "d1": "(e.d1*9+b.d)/10"}) + joined("a1", "b"), "a1j")
    line = f"({ema_step('f', 12, 'b.close')}) - ({ema_step('s', 26, 'b.close')})"
    recursive("macd", [R.Call(("line", "sig", "hist"), "macd", (12, 26, 9), "close")], {"line": "f-s", "sig": "g", "hist": "f-s-g"}, rec("e1", "b", "b.i=1", {"f": "b.close", "s": "b.close", "g": "0"}, {"f": ema_step("f", 12, "b.close"), "s": ema_step("s", 26, "b.close"), "g": ema_step("g", 9, line)}) + joined("e1", "b"), "e1j")
    n1, n2 = ema_step("a", 25, "b.close-b.pc"), ema_step("c", 25, "abs(b.close-b.pc)")
    recursive("tsi", [R.Call(("x",), "tsi", (13, 25), "close")], {"x": "p/nullif(q,0)"}, rec("e1", "b", "b.i=2", {"a": "b.close-b.pc", "p": "b.close-b.pc", "c": "abs(b.close-b.pc)", "q": "abs(b.close-b.pc)"}, {"a": n1, "p": ema_step("p", 13, n1), "c": n2, "q": ema_step("q", 13, n2)}) + joined("e1", "b"), "e1j")
    kc_cte = f", a0 AS (SELECT *, {tr1} AS tr FROM b)" + rec("e1", "a0", "b.i=1", {"m": "b.close", "s": "b.tr"}, {"m": ema_step("m", 20, "b.close"), "s": ema_step("s", 20, "b.tr")}) + joined("e1", "b")
    recursive("kc_kcw", [R.Call(("mid", "kup", "klow"), "kc", (20, 1.5), "close"), R.Call(("w",), "kcw", (20, 1.5), "close")], {"mid": "m", "kup": "m+1.5*s", "klow": "m-1.5*s", "w": "3*s/nullif(m,0)"}, kc_cte, "e1j")
    f14 = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    pdm = "CASE WHEN high-hp>lp-low AND high-hp>0 THEN high-hp ELSE 0 END"
    mdm = "CASE WHEN lp-low>high-hp AND lp-low>0 THEN lp-low ELSE 0 END"
    dmi_cte = f", a0 AS (SELECT *, {tr1} AS tr, lag(high) OVER {W} AS hp, lag(low) OVER {W} AS lp FROM b), a2 AS (SELECT *, {pdm} AS p, {mdm} AS m FROM a0), a3 AS (SELECT *, avg(tr) OVER {f14} AS tr0, avg(p) OVER {f14} AS p0, avg(m) OVER {f14} AS m0 FROM a2)"
    dmi_cte += rec("e1", "a3", "b.i=14", {"t": "b.tr0", "pp": "b.p0", "mm": "b.m0"}, {"t": "(e.t*13+b.tr)/14", "pp": "(e.pp*13+b.p)/14", "mm": "(e.mm*13+b.m)/14"}) + joined("e1", "b")
    dmi_cte += f", x1 AS (SELECT *, CASE WHEN t=0 THEN 0 ELSE 100*pp/t END AS plus, CASE WHEN t=0 THEN 0 ELSE 100*mm/t END AS minus FROM e1j), x2 AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN plus+minus=0 THEN 0 ELSE 100*abs(plus-minus)/(plus+minus) END AS dx FROM x1), x3 AS (SELECT *, avg(dx) OVER {f14} AS dx0 FROM x2)"
    dmi_cte += rec("e2", "x3", "b.i=27", {"adx": "b.dx0"}, {"adx": "(e.adx*13+b.dx)/14"}) + ", x4 AS (SELECT x3.*, e2.adx FROM x3 LEFT JOIN e2 USING (symbol, i))"
    recursive("dmi", [R.Call(("plus", "minus", "adx"), "dmi", (14, 14))], {"plus": "CASE WHEN i>=14 THEN plus END", "minus": "CASE WHEN i>=14 THEN minus END", "adx": "adx"}, dmi_cte, "x4")
    st = f", a0 AS (SELECT *, {tr1} AS tr, avg({tr1}) OVER {f10} AS mtr, (high+low)/2 AS mid FROM b)" + rec("a1", "a0", "b.i=10", {"x": "b.mtr"}, {"x": "(e.x*9+b.tr)/10"}) + ", a4 AS (SELECT a0.*, 3*x AS w FROM a0 LEFT JOIN a1 USING (symbol, i))"
    lower = "CASE WHEN e.px > e.a THEN greatest(b.mid-b.w, e.a) ELSE b.mid-b.w END"
    upper = "CASE WHEN e.px < e.u THEN least(b.mid+b.w, e.u) ELSE b.mid+b.w END"
    st += rec("e1", "a4", "b.i=10", {"a": "b.mid-b.w", "u": "b.mid+b.w", "d": "CASE WHEN b.close > b.mid+b.w THEN -1 ELSE 1 END", "px": "b.close"}, {"a": lower, "u": upper, "d": f"CASE WHEN e.d=1 THEN (CASE WHEN b.close > ({upper}) THEN -1 ELSE 1 END) ELSE (CASE WHEN b.close < ({lower}) THEN 1 ELSE -1 END) END", "px": "b.close"}) + joined("e1", "b")
    recursive("supertrend", [R.Call(("line", "dir"), "supertrend", (3.0, 10))], {"line": "CASE WHEN d=-1 THEN a ELSE u END", "dir": "coalesce(d,1)"}, st, "e1j")
    # the state of a stop: trend (1 below the price), extreme price, stop, speed; a step is written in layers
    sar_row = f", v0 AS (SELECT *, lag(high) OVER {W} AS h1, lag(low) OVER {W} AS l1, lag(high,2) OVER {W} AS h2, lag(low,2) OVER {W} AS l2 FROM b)"
    sar_step = (  # of (below, ext, y, speed, fresh) and a row: the stop moves, the trend may turn, the extreme may grow, two bars clamp
        "SELECT symbol, i, nb AS below, CASE WHEN turn THEN CASE WHEN below THEN low ELSE high END WHEN better THEN CASE WHEN below THEN high ELSE low END ELSE ext END AS ext, CASE WHEN nb THEN least(ny, coalesce(l1, ny), coalesce(l2, ny)) ELSE greatest(ny, coalesce(h1, ny), coalesce(h2, ny)) END AS y,"
        " CASE WHEN turn THEN 0.02::DOUBLE WHEN better THEN least(speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE speed END AS speed FROM (SELECT *, below <> turn AS nb, CASE WHEN turn THEN CASE WHEN below THEN greatest(high, ext) ELSE least(low, ext) END ELSE y1 END AS ny, NOT fresh AND NOT turn AND CASE WHEN below THEN high > ext ELSE low < ext END AS better"
        " FROM (SELECT *, CASE WHEN below THEN y1 > low ELSE y1 < high END AS turn FROM (SELECT *, y + speed * (ext - y) AS y1 FROM ({0}))))"
    )
    sar_seed = "SELECT symbol, i, high, low, h1, l1, h2, l2, close > pc AS below, CASE WHEN close > pc THEN high ELSE low END AS ext, CASE WHEN close > pc THEN l1 ELSE h1 END AS y, 0.02::DOUBLE AS speed, true AS fresh FROM v0 WHERE i = 2"
    sar_next = "SELECT v0.symbol, v0.i, high, low, h1, l1, h2, l2, e.below, e.ext, e.y, e.speed, false AS fresh FROM sar e JOIN v0 ON v0.symbol = e.symbol AND v0.i = e.i + 1"
    bars_query("sar", {"x": (F.col("x"), "y")}, ctes=f"{sar_row}, sar AS ({sar_step.format(sar_seed)} UNION ALL {sar_step.format(sar_next)}), sj AS (SELECT b.*, sar.y FROM b LEFT JOIN sar USING (symbol, i))", source="sj", prepare=lambda d: R.with_recursive(d, [R.Call(("x",), "sar", (0.02, 0.02, 0.2))]))
    # --- na comparisons and scalars
    bars_query("na_comparisons", {"d": (div(F.col("x"), F.col("volume") - 1), "x/nullif(volume-1,0)"), "m": (mod(F.col("x"), F.lit(7.5)), "fmod(x,7.5::DOUBLE)")}, {
        "l": (lt("x", "open"), "coalesce(x<open,false)"), "g": (gt("x", "open"), "coalesce(x>open,false)"), "e": (eq("x", "close"), "coalesce(round(x*1e9)=round(close*1e9),false)"), "n": (ne("x", "close"), "coalesce(round(x*1e9)<>round(close*1e9),false)"),
        "ge_": (ge("x", "open"), "coalesce(x>=open,false)"), "le_": (le("x", "open"), "coalesce(x<=open,false)"), "t": (to_int("x"), "trunc(x)::BIGINT"),
    }, ctes=", n1 AS (SELECT *, CASE WHEN volume > 1 THEN close END AS x FROM b)", source="n1", prepare=nulls)
    bars_query("math_scalars", {
        "mx": (S.max_of("open", "close", "x"), "CASE WHEN x IS NOT NULL THEN greatest(open,close,x) END"), "mn": (S.min_of("open", "close"), "least(open,close)"), "av": (S.avg_of("open", "close", "x"), "(open+close+x)/3"),
        "rd": (S.round_half_away("close", 1), "sign(close)*floor(abs(close)*10+0.5::DOUBLE)/10"), "mt": (S.round_to_mintick(c / 3), "sign(close/3)*floor(abs(close/3)*100+0.5::DOUBLE)/100"), "sq": (S.sqrt(c - 50), "CASE WHEN close>=50 THEN sqrt(close-50) END"),
        "pw": (S.power(c / 100, 1.5), "pow(close/100,1.5::DOUBLE)"), "sg": (S.sign(c - o), "sign(close-open)"), "fl": (S.floor("close"), "floor(close)"), "ce": (S.ceil("close"), "ceil(close)"), "ab": (F.abs(c - o), "abs(close-open)"),
        "ln": (F.ln(c + 1), "ln(close+1)"), "lg": (F.log10(c + 1), "log10(close+1)"), "ex": (F.exp(c / 100), "exp(close/100)"), "sn": (F.sin("close"), "sin(close)"), "cs": (F.cos("close"), "cos(close)"), "at": (F.atan("close"), "atan(close)"),
        "a2": (F.atan2("open", "close"), "atan2(open,close)"), "as_": (S.asin(c / 1000), "asin(close/1000)"), "ac": (S.acos(c / 1000), "acos(close/1000)"), "dg": (F.degrees(c / 100), "degrees(close/100)"), "ra": (F.radians("close"), "radians(close)"),
        "fc": (S.factorial(v), "factorial(volume::INT)::DOUBLE"),
    }, {"gd": (S.gcd(F.floor(c), F.lit(12)), "gcd(floor(close)::BIGINT, 12)")}, ctes=", n1 AS (SELECT *, CASE WHEN volume > 1 THEN close END AS x FROM b)", source="n1", prepare=nulls)
    low32 = "4294967296::UBIGINT"
    random_cte = (
        f", n1 AS (SELECT *, (volume::UBIGINT + 1831565813::UBIGINT) % {low32} AS a FROM b), n2 AS (SELECT *, xor(a, a >> 15) * (a | 1::UBIGINT) % {low32} AS t FROM n1),"
        f" n3 AS (SELECT *, xor(t, (t + xor(t, t >> 7) * (t | 61::UBIGINT) % {low32}) % {low32}) AS t2 FROM n2), n4 AS (SELECT *, xor(t2, t2 >> 14)::DOUBLE / 4294967296 AS u FROM n3)"
    )
    bars_query("math_random", {"x": (S.random(F.col("volume"), 0, 10), "u*10")}, ctes=random_cte, source="n4")
    text = "concat(symbol, '-', CAST(volume::INT AS VARCHAR), '-', symbol)"
    t = F.concat("symbol", F.lit("-"), v.cast("int").cast("string"), F.lit("-"), F.col("symbol"))
    bars_query("str_scalars", {"num": (S.str_tonumber(F.split(t, "-")[1]), "try_cast(split_part(t,'-',2) AS DOUBLE)")}, {
        "len_": (F.length(t), "length(t)::INT"), "has": (S.contains(t, F.lit("1-")), "contains(t,'1-')"), "p": (S.str_pos(t, "-"), "instr(t,'-')::INT-1"), "up": (F.upper(t), "upper(t)"), "lo_": (F.lower(F.upper(t)), "lower(t)"),
        "st": (F.startswith(t, F.lit("c")), "starts_with(t,'c')"), "en": (F.endswith(t, F.lit("k")), "ends_with(t,'k')"), "sub": (S.str_substring(t, 2, 6), "substr(t,3,4)"), "ra_": (F.replace(t, F.lit("-"), F.lit("+")), "replace(t,'-','+')"),
        "r1": (S.str_replace(t, "-", "::", 1), "concat(split_part(t,'-',1),'-',split_part(t,'-',2),'::',split_part(t,'-',3))"), "rp": (S.str_repeat("symbol", 3, "/"), "concat(symbol,'/',symbol,'/',symbol)"), "tm": (S.str_trim(F.concat(F.lit("  "), t, F.lit(" "))), "t"),
        "mt": (S.str_match(t, "[0-9]+"), "regexp_extract(t,'[0-9]+')"), "sp": (F.size(S.str_split(t, "-")), "len(string_split(t,'-'))::INT"), "fm": (S.str_tostring("volume", "0.00"), "concat(CAST(volume::INT AS VARCHAR),'.00')"),
        "ff": (S.str_format("{0}: {1,number,#}", F.col("symbol"), F.col("volume")), "concat(symbol,': ',CAST(volume::INT AS VARCHAR))"), "ft": (S.str_format_time("time", "yyyy-MM-dd HH:mm"), "strftime(time,'%Y-%m-%d %H:%M')"),
    }, ctes=f", t1 AS (SELECT *, {text} AS t FROM b)", source="t1")
    rgb = S.color_rgb(c % 256, o % 256, h % 256, 25)
    hexa = lambda x: f"printf('%02X', (floor(abs({x})+0.5::DOUBLE))::INT)"
    bars_query("color_scalars", {"r": (S.color_r(rgb), "least(floor(fmod(close,256)+0.5::DOUBLE),255)"), "t": (S.color_t(rgb), "25")}, {
        "rgb": (rgb, f"concat('#',{hexa('least(fmod(close,256),255)')},{hexa('least(fmod(open,256),255)')},{hexa('least(fmod(high,256),255)')},'BF')"),
        "new": (S.color_new(F.lit("#112233FF"), 50), "'#11223380'"), "named": (F.lit(S.COLORS["red"]), "'#F23645FF'"), "grad": (S.color_from_gradient("close", F.lit(0.0), F.lit(1e9), F.lit("#000000FF"), F.lit("#FFFFFFFF")), "'#000000FF'"),
    })
    parts = S.date_parts("time")
    bars_query("date_parts", {}, {n: (parts[n].cast("int"), s) for n, s in {"year": "year(time)::INT", "month": "month(time)::INT", "dayofmonth": "day(time)::INT", "dayofweek": "dayofweek(time)::INT+1", "hour": "hour(time)::INT", "minute": "minute(time)::INT", "second": "second(time)::INT", "weekofyear": "ceil(dayofyear(time)/7.0)::INT"}.items()})
    bars_query("timestamp_ctor", {}, {"t": (S.timestamp(F.year("time"), F.month("time"), F.lit(1), 6, 30).cast("timestamp_ntz"), "make_timestamp(year(time),month(time),1,6,30,0)")})
    ends, point = timeframe.last_bar(), timeframe.chart_point("time", ta.KEYS.index(), "high")
    bars_query("clock_names", {"p": (point["price"], "high")}, {
        "li": (ends["last_bar_index"], "count(*) OVER (PARTITION BY symbol) - 1"), "lt": (ends["last_bar_time"], "max(time) OVER (PARTITION BY symbol)"), "td": (ends["time_tradingday"], "date_trunc('day', time)::TIMESTAMP"), "pi": (point["index"], "i - 1"), "pn": (timeframe.chart_point(price="low")["time"].isNull(), "true"),
        "tx": (S.timestamp_of(F.date_format("time", "yyyy-MM-dd HH:mm")), "time"), "ty": (S.timestamp_of(F.date_format("time", "yyyy-MM-dd")), "date_trunc('day', time)::TIMESTAMP"), "tn": (S.timestamp_of(F.lit("no time")).isNull(), "true"),
    })
    bars_query("session_filter", {}, {"day": (timeframe.in_session("time", "0930-1600:23456"), "(hour(time)*60+minute(time) >= 570 AND hour(time)*60+minute(time) < 960 AND dayofweek(time) BETWEEN 1 AND 5)"), "night": (timeframe.in_session("time", "2200-0400"), "(hour(time)*60+minute(time) >= 1320 OR hour(time)*60+minute(time) < 240)")})
    bars_query("timeframe_change", {}, {"day": (timeframe.change("1D"), "coalesce(time::DATE <> pt::DATE, true)"), "h4": (timeframe.change("240"), "coalesce(floor(epoch(time)/14400) <> floor(epoch(pt)/14400), true)")}, ctes=f", p1 AS (SELECT *, lag(time) OVER {W} AS pt FROM b)", source="p1")
    flags = timeframe.session_flags()
    state = timeframe.bar_state()
    bars_query("session_and_bar_state", {}, {"f": (flags["isfirstbar"], f"coalesce(time::DATE <> lag(time) OVER {W}::DATE, true)"), "l": (flags["islastbar"], f"coalesce(time::DATE <> lead(time) OVER {W}::DATE, true)"), "bf": (state["isfirst"], "i=1"), "bl": (state["islast"], f"lead(time) OVER {W} IS NULL"), "tc": (timeframe.time_close("60"), "time + INTERVAL 1 HOUR"), "idx": (ta.KEYS.index().cast("long"), "i-1")})
    # --- collections
    av = F.collect_list("close").over(ta.KEYS.last(6))
    arr = lambda d: d.withColumn("a", av).where(F.size("a") == 6)
    acte = f", a0 AS (SELECT *, list(close) OVER {frame(6)} AS a FROM b), a1 AS (SELECT * FROM a0 WHERE i>=6)"
    rl = lambda x: F.transform(x, lambda y: F.round(y, 6) + 0.0)
    ls = lambda x: f"list_transform({x}, lambda y: round(y,6) + 0.0)"
    bars_query("array_reducers", {
        "s": (A.sum_("a"), "list_sum(a)"), "m": (A.avg("a"), "list_avg(a)"), "mn": (A.min_("a", 1), "list_sort(a)[2]"), "mx": (A.max_("a", 1), "list_reverse_sort(a)[2]"), "md": (A.median("a"), "list_median(a)"), "vr": (A.variance("a"), "list_var_pop(a)"),
        "sv": (A.stdev("a", False), "list_stddev_samp(a)"), "rg": (A.range_("a"), "list_max(a)-list_min(a)"), "p1": (A.percentile_nearest_rank("a", 50), "list_sort(a)[3]"), "p2": (A.percentile_linear_interpolation("a", 50), "list_median(a)"),
        "pr": (A.percentrank("a", 2), "100.0::DOUBLE*len(list_filter(a, lambda y: y < a[3]))/5"), "f": (A.first("a"), "a[1]"), "l": (A.last("a"), "a[6]"), "g": (A.get("a", 3), "a[4]"), "cv": (A.covariance("a", A.reverse("a")), "list_sum(list_transform(a, lambda y, n: y*a[7-n]))/6 - list_avg(a)*list_avg(a)"),
        "mo": (A.mode(F.transform("a", lambda y: F.floor(y / 50))), "list_sort(list_filter(fa, lambda u: len(list_filter(fa, lambda z: z=u)) = list_max(list_transform(fa, lambda z: len(list_filter(fa, lambda y: y=z))))))[1]"),
    }, {"ix": (A.indexof("a", A.get("a", 3)).cast("long"), "list_position(a,a[4])::BIGINT-1"), "ic": (A.includes("a", F.lit(-1.0)), "list_contains(a,-1)"), "ev": (A.every("a"), "len(list_filter(a, lambda y: y=0))=0"), "so": (A.some("a"), "len(list_filter(a, lambda y: y<>0))>0"), "sz": (A.size("a"), "len(a)::INT"),
        "bl": (A.binary_search_leftmost(A.sort("a"), F.lit(100.0)), "CASE WHEN list_contains(a,100) THEN len(list_filter(a, lambda y: y<100))::INT ELSE len(list_filter(a, lambda y: y<100))::INT-1 END"), "br": (A.binary_search_rightmost(A.sort("a"), F.lit(100.0)), "CASE WHEN list_contains(a,100) THEN len(list_filter(a, lambda y: y<=100))::INT-1 ELSE len(list_filter(a, lambda y: y<=100))::INT END")},
        ctes=acte + ", a2 AS (SELECT *, list_transform(a, lambda y: floor(y/50)) AS fa FROM a1)", source="a2", prepare=arr)
    j = lambda x: F.array_join(F.transform(x, lambda y: F.round(y, 4).cast("decimal(20,4)").cast("string")), ",")
    js = lambda x: f"array_to_string(list_transform({x}, lambda y: CAST(round(y,4)::DECIMAL(20,4) AS VARCHAR)), ',')"
    bars_query("array_edits", {}, {
        "push": (j(A.push("a", F.lit(1.0))), js("list_append(a,1.0::DOUBLE)")), "uns": (j(A.unshift("a", F.lit(1.0))), js("list_prepend(1.0::DOUBLE,a)")), "pop": (j(A.pop("a")), js("a[1:5]")), "shf": (j(A.shift("a")), js("a[2:6]")), "set": (j(A.set_("a", 2, F.lit(7.0))), js("list_transform(a, lambda y, n: CASE WHEN n=3 THEN 7.0::DOUBLE ELSE y END)")),
        "ins": (j(A.insert("a", 2, F.lit(7.0))), js("list_concat(a[1:2],[7.0::DOUBLE],a[3:6])")), "rem": (j(A.remove("a", 2)), js("list_concat(a[1:2],a[4:6])")), "rev": (j(A.reverse("a")), js("list_reverse(a)")), "srt": (j(A.sort("a", "descending")), js("list_reverse_sort(a)")), "slc": (j(A.slice_("a", 1, 4)), js("a[2:4]")), "cat": (j(A.concat("a", "a")), js("list_concat(a,a)")),
        "fil": (j(A.fill("a", F.lit(0.0), 1, 3)), js("list_transform(a, lambda y, n: CASE WHEN n IN (2,3) THEN 0.0::DOUBLE ELSE y END)")), "abs": (j(A.abs_("a")), js("list_transform(a, lambda y: abs(y))")), "new": (j(A.new(3, 2.0)), js("[2.0::DOUBLE,2.0::DOUBLE,2.0::DOUBLE]")), "frm": (j(A.from_("open", "close")), js("[open,close]")),
        "six": (A.join(A.sort_indices("a")), "array_to_string(list_transform(list_sort(list_transform(a, lambda y, n: {'v': y, 'n': n-1})), lambda s: s.n), ',')"), "std": (j(A.standardize("a")), js("list_transform(a, lambda y: coalesce((y-list_avg(a))/nullif(list_stddev_pop(a),0),0))")),
    }, ctes=acte, source="a1", prepare=arr)
    kinds = {"float": (2.5, "2.5"), "int": (7, "7"), "bool": (True, "true"), "string": ("s", "s"), "color": ("#112233FF", "#112233FF"), **{k: (n, str(n)) for n, k in enumerate(("line", "label", "box", "table", "linefill"), 1)}}
    said = lambda x: F.concat_ws(",", F.transform(x, lambda v: v.cast("string")))
    bars_query("array_kinds", {}, {**{f"new_{k}": (said(getattr(A, f"new_{k}")(2, x)), f"'{t},{t}'") for k, (x, t) in kinds.items()}, **{f"empty_{k}": (F.size(getattr(A, f"new_{k}")()), "0") for k in kinds}, "na": (F.size(F.filter(A.new_float(3), lambda v: v.isNull())), "3")})
    bars_query("array_lookups", {"c": (A.sum_(A.copy("a")), "list_sum(a)")}, {
        "li": (A.lastindexof("a", F.col("close")).cast("long"), "5::BIGINT"), "ln": (A.lastindexof("a", F.lit(-1.0)).cast("long"), "-1::BIGINT"), "bs": (A.binary_search(A.sort("a"), A.get(A.sort("a"), 2)).cast("long"), "list_position(list_sort(a), list_sort(a)[3])::BIGINT - 1"), "cl": (A.size(A.clear("a")), "0"),
    }, ctes=acte, source="a1", prepare=arr)
    mp1 = M.put(M.put(F.create_map(F.lit("a"), F.col("open")), F.lit("b"), F.col("close")), F.lit("a"), F.col("high"))
    bars_query("map_functions", {"a": (M.get(mp1, F.lit("a")), "high"), "b": (M.get(mp1, F.lit("b")), "close"), "z": (M.get(mp1, F.lit("z")), "NULL::DOUBLE"), "pa": (M.get(M.put_all(mp1, F.create_map(F.lit("b"), F.col("low"))), F.lit("b")), "low"), "vs": (A.sum_(M.values(mp1)), "high+close")}, {
        "has": (M.contains(mp1, F.lit("b")), "true"), "n": (M.size(mp1), "2"), "ks": (F.array_join(M.keys(mp1), ","), "'a,b'"), "rm": (F.array_join(M.keys(M.remove(mp1, F.lit("a"))), ","), "'b'"), "cl": (M.size(M.clear(mp1)), "0"), "cp": (M.size(M.copy(mp1)), "2"), "nw": (M.size(M.new()), "0"),
    })
    m = F.array(F.array("open", "high"), F.array("low", "close"))
    g = lambda x, a, b: X.get(x, F.lit(a), F.lit(b))
    bars_query("matrix_basic", {
        "tr": (X.trace(m), "open+close"), "t01": (g(X.transpose(m), 0, 1), "low"), "mm": (g(X.mult(m, m), 0, 1), "open*high+high*close"), "mv": (A.get(X.mult(m, F.array("open", "close"), "vector"), 1), "low*open+close*close"), "ms": (g(X.mult(m, 2.0), 1, 0), "2*low"), "sm": (g(X.sum_(m, m), 1, 1), "2*close"), "df": (g(X.diff(m, 1.0), 0, 0), "open-1"),
        "av": (X.avg(m), "(open+high+low+close)/4"), "mx": (X.max_(m), "greatest(open,high,low,close)"), "mi": (X.min_(m), "least(open,high,low,close)"), "md": (X.median(m), "list_median([open,high,low,close])"), "sw": (g(X.swap_rows(m, 0, 1), 0, 0), "low"), "sc": (g(X.swap_columns(m, 0, 1), 0, 0), "high"), "rs": (g(X.reshape(m, 1, 4), 0, 2), "low"),
        "sb": (g(X.submatrix(m, 1, 2, 0, 2), 0, 1), "close"), "kr": (g(X.kron(m, m), 0, 3), "high*high"), "rv": (g(X.reverse(m), 0, 0), "close"), "st": (g(X.set_(m, 0, 0, F.lit(5.0)), 0, 0), "5"), "so": (g(X.sort(m, 0), 0, 0), "least(open,low)"), "cc": (g(X.concat(m, m), 3, 1), "close"), "rr": (g(X.remove_row(m, 0), 0, 0), "low"), "rc": (g(X.remove_col(m, 0), 0, 0), "high"),
        "ar": (g(X.add_row(m, F.array("open", "close"), 0), 0, 1), "close"), "acl": (g(X.add_col(m, F.array("open", "close"), 0), 1, 0), "close"), "fl": (g(X.fill(m, 0.0, 0, 1), 0, 1), "0"), "cl": (A.get(X.col_(m, F.lit(1)), 1), "close"), "rw": (A.get(X.row(m, F.lit(1)), 1), "close"), "oo": (g(m, 5, 0), "NULL::DOUBLE"),
    }, {"r": (X.rows(m), "2"), "c": (X.columns(m), "2"), "n": (X.elements_count(m), "4"), "sq": (X.is_square(m), "true"), "sy": (X.is_symmetric(m), "high=low"), "ze": (X.is_zero(m), "open=0 AND high=0 AND low=0 AND close=0"), "dg": (X.is_diagonal(m), "high=0 AND low=0"), "ad": (X.is_antidiagonal(m), "open=0 AND close=0"), "as_": (X.is_antisymmetric(m), "open=0 AND close=0 AND high=-low"), "bn": (X.is_binary(m), "open IN (0,1) AND high IN (0,1) AND low IN (0,1) AND close IN (0,1)"), "tg": (X.is_triangular(m), "low=0 OR high=0"), "sto": (X.is_stochastic(m), "open>=0 AND high>=0 AND low>=0 AND close>=0 AND abs(open+high-1)<=1e-10 AND abs(low+close-1)<=1e-10"), "id": (X.is_identity(m), "open=1 AND close=1 AND high=0 AND low=0")})
    few = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.col("close")))
    bars_query("matrix_small", {"nw": (g(X.new(2, 3, 4.0), 1, 2), "4"), "cp": (g(X.copy(m), 1, 0), "low"), "mo": (X.mode(few), "CASE WHEN close = 1 THEN 1 ELSE 2 END"), "tan": (F.tan("close"), "tan(close)")}, {
        "nr": (X.rows(X.new(2, 3)), "2"), "cg": (S.color_g(F.lit("#102030FF")).cast("int"), "32"), "cb": (S.color_b(F.lit("#102030FF")).cast("int"), "48"), "em": (X.elements_count(X.new()), "0"),
    })
    md2 = F.array(F.array(F.col("open") + 1, F.lit(2.0)), F.array(F.lit(2.0), F.col("close") + 7))
    det = "((open+1)*(close+7)-4)"
    mid = "((open+1)+(close+7))/2"
    disc = "sqrt(pow(((open+1)-(close+7))/2,2)+4)"
    r4d = lambda x: F.round(x, 4)
    bars_query("matrix_linear_algebra", {
        "det": (r4d(X.det(md2)), f"round({det},4)"), "inv": (r4d(g(X.inv(md2), 0, 0)), f"round((close+7)/{det},4)"), "pinv": (r4d(g(X.pinv(md2), 0, 1)), f"round(-2/{det},4)"), "e0": (r4d(A.get(X.eigenvalues(md2), 0)), f"round({mid}+{disc},4)"), "e1": (r4d(A.get(X.eigenvalues(md2), 1)), f"round({mid}-{disc},4)"),
        "pw": (F.round(g(X.pow_(md2, 2), 0, 1), 3), "round(2*(open+1)+2*(close+7),3)"), "v0": (r4d(g(X.eigenvectors(md2), 0, 0)), f"round(2/sqrt(4+pow({mid}+{disc}-(open+1),2)),4)"),
    }, {"rk": (X.rank(md2), "2")})
    # --- requests
    daily = lambda late: f", d1 AS (SELECT symbol, floor(epoch(time)/86400)::BIGINT AS k, arg_max(close,time) AS dc, max(high) AS dh FROM b GROUP BY 1,2), d2 AS (SELECT *, avg(dc) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m0, row_number() OVER (PARTITION BY symbol ORDER BY k) AS n FROM d1), d3 AS (SELECT symbol, k, {late('dc')} AS dc, {late('dh')} AS dh, {late('CASE WHEN n>=3 THEN m0 END')} AS dm FROM d2), j1 AS (SELECT b.*, dc, dh, dm FROM b LEFT JOIN d3 ON d3.symbol=b.symbol AND d3.k=floor(epoch(b.time)/86400)::BIGINT)"
    expr = lambda d: d.select("*", F.col("close").alias("dc"), F.col("high").alias("dh"), ta.sma("close", 3).alias("dm"))
    for name, ahead, late in (("security_htf_off", False, lambda x: f"lag({x}) OVER (PARTITION BY symbol ORDER BY k)"), ("security_htf_on", True, lambda x: x)):
        bars_query(name, {"dc": (F.col("dc"), "dc"), "dh": (F.col("dh"), "dh"), "dm": (F.col("dm"), "dm")}, ctes=daily(late), source="j1", prepare=lambda d, ahead=ahead: Q.security(d, "1D", expr, ["dc", "dh", "dm"], lookahead=ahead))
    bars_query("security_gaps", {"dc": (F.col("dc"), "CASE WHEN i=1 OR time::DATE<>pt::DATE THEN dc END")}, ctes=daily(lambda x: f"lag({x}) OVER (PARTITION BY symbol ORDER BY k)") + f", j2 AS (SELECT *, lag(time) OVER {W} AS pt FROM j1)", source="j2", prepare=lambda d: Q.security(d, "1D", expr, ["dc"], gaps=True))
    bars_query("security_cross_symbol", {"dc": (F.col("dc"), "dc")}, prepare=lambda d: Q.cross_symbol(d, d.where(F.col("symbol") == "click"), "1D", expr, ["dc"]), source="j1",
      ctes=", d1 AS (SELECT floor(epoch(time)/86400)::BIGINT AS k, arg_max(close,time) AS dc FROM b WHERE symbol='click' GROUP BY 1), j1 AS (SELECT b.*, d1.dc FROM b ASOF LEFT JOIN d1 ON d1.k < floor(epoch(b.time)/86400)::BIGINT)")
    half = lambda d: Q.resample(d, "240").select("symbol", "time", F.col("close").alias("ic"))
    bars_query("security_injected_close", {"ic": (F.col("ic"), "ic")}, prepare=lambda d: Q.injected(d, half(d), ["ic"], "240"), source="j1",
      ctes=f""", s0 AS (SELECT symbol, min(time) AS time, arg_max(close,time) AS ic FROM b GROUP BY symbol, floor(epoch(time)/14400)), s1 AS (SELECT *, coalesce(lead(time) OVER {W}, time + INTERVAL 4 HOUR) AS ct FROM s0), c1 AS (SELECT *, coalesce(lead(time) OVER {W}, time + INTERVAL 1 HOUR) AS ct FROM b),
      j1 AS (SELECT c1.*, s1.ic FROM c1 ASOF LEFT JOIN s1 ON s1.symbol=c1.symbol AND s1.ct <= c1.ct)""")
    register(
        "security_lower_tf",
        lambda s, d: Q.lower_timeframe(Q.resample(event_bars(s, d), "1D").drop("bucket"), event_bars(s, d), {"lc": F.col("close"), "lv": F.col("volume")}).select("symbol", "time", F.size("lc").cast("long").alias("n"), r6(A.sum_("lc")).alias("s"), r6(A.first("lc")).alias("f"), r6(A.last("lc")).alias("l"), r6(A.max_("lv")).alias("v")),
        f"WITH {BARS} SELECT symbol, min(time) AS time, count(*) AS n, {q6('sum(close)')} AS s, {q6('arg_min(close,time)')} AS f, {q6('arg_max(close,time)')} AS l, {q6('max(volume)')} AS v FROM b GROUP BY symbol, time::DATE",
    )
    # --- backtests
    sig_cte = cross_cte + f", w1 AS (SELECT *, CASE WHEN {over} THEN 1 WHEN {under} THEN 0 END AS sg FROM s2), w2 AS (SELECT *, coalesce(last_value(sg IGNORE NULLS) OVER {CUM},0) AS wish FROM w1), h1 AS (SELECT *, coalesce(lag(wish) OVER {W},0) AS pos FROM w2), h2 AS (SELECT *, coalesce(lag(pos) OVER {W},0) AS ppos FROM h1)"
    turn_cte = sig_cte + f", t0 AS (SELECT * FROM h2 WHERE pos<>ppos), t1 AS (SELECT *, lead(open) OVER {W} AS xp, lead(time) OVER {W} AS xt, lead(i) OVER {W} AS xi FROM t0), tr AS (SELECT symbol, time AS entry_time, xt AS exit_time, i-1 AS entry_bar, xi-1 AS exit_bar, open AS entry_price, xp AS exit_price, xp-open AS profit FROM t1 WHERE pos=1 AND xt IS NOT NULL)"

    def held(d: DataFrame) -> DataFrame:
        return G.positions(smas(d).withColumn("enter", ta.crossover("f", "s")).withColumn("leave", ta.crossunder("f", "s")), "enter", "leave")

    bars_query("signal_backtest", {}, {"position": (F.col("position"), "pos")}, ctes=sig_cte, source="h1", prepare=held)
    register(
        "trade_ledger", lambda s, d: G.trades(held(event_bars(s, d))).select("symbol", "entry_time", "exit_time", F.col("entry_bar").cast("long").alias("entry_bar"), F.col("exit_bar").cast("long").alias("exit_bar"), *[r6(F.col(x)).alias(x) for x in ("entry_price", "exit_price", "profit", "cum_profit")]),
        f"WITH {BARS}{turn_cte} SELECT symbol, entry_time, exit_time, entry_bar, exit_bar, {q6('entry_price')} AS entry_price, {q6('exit_price')} AS exit_price, {q6('profit')} AS profit, {q6('sum(profit) OVER (PARTITION BY symbol ORDER BY entry_time ROWS UNBOUNDED PRECEDING)')} AS cum_profit FROM tr",
    )
    eq_cte = sig_cte + f", q1 AS (SELECT *, coalesce(coalesce(lag(pos) OVER {W},0)*(open-pc),0) + pos*(close-open) AS gain FROM h2), q2 AS (SELECT *, 10000+sum(gain) OVER {CUM} AS equity FROM q1)"
    bars_query("equity_curve", {"equity": (F.col("equity"), "equity")}, ctes=eq_cte, source="q2", prepare=lambda d: G.equity(held(d), 10_000.0))
    register(
        "trade_metrics", lambda s, d: (lambda t: t.select("symbol", "trades", "wins", "losses", "evens", *[r6(F.col(x)).alias(x) for x in ("gross_profit", "gross_loss", "net_profit", "avg_trade", "avg_win", "avg_loss", "profit_factor", "largest_win", "largest_loss", "avg_bars")]))(G.trade_metrics(G.trades(held(event_bars(s, d))))),
        f"""WITH {BARS}{turn_cte} SELECT symbol, count(*) AS trades, count(*) FILTER (profit>0) AS wins, count(*) FILTER (profit<0) AS losses, count(*) FILTER (profit=0) AS evens, {q6('coalesce(sum(profit) FILTER (profit>0),0)')} AS gross_profit, {q6('coalesce(-sum(profit) FILTER (profit<0),0)')} AS gross_loss,
        {q6('sum(profit)')} AS net_profit, {q6('avg(profit)')} AS avg_trade, {q6('avg(profit) FILTER (profit>0)')} AS avg_win, {q6('avg(-profit) FILTER (profit<0)')} AS avg_loss, {q6('sum(profit) FILTER (profit>0) / nullif(-sum(profit) FILTER (profit<0),0)')} AS profit_factor, {q6('max(profit) FILTER (profit>0)')} AS largest_win, {q6('max(-profit) FILTER (profit<0)')} AS largest_loss, {q6('avg(exit_bar-entry_bar)')} AS avg_bars FROM tr GROUP BY symbol""",
    )
    register(
        "trade_streaks", lambda s, d: G.streaks(G.trades(held(event_bars(s, d)))),
        f"""WITH {BARS}{turn_cte}, k1 AS (SELECT *, sign(profit) AS s, row_number() OVER (PARTITION BY symbol ORDER BY exit_time) - row_number() OVER (PARTITION BY symbol, sign(profit) ORDER BY exit_time) AS g FROM tr), k2 AS (SELECT symbol, s, g, count(*) AS n FROM k1 GROUP BY ALL)
        SELECT symbol, coalesce(max(n) FILTER (s=1),0) AS max_wins, coalesce(max(n) FILTER (s=-1),0) AS max_losses FROM k2 GROUP BY symbol""",
    )
    register(
        "metrics_summary", lambda s, d: G.equity_metrics(G.equity(held(event_bars(s, d)), 10_000.0), 8766.0).select("symbol", *[r6(F.col(x)).alias(x) for x in ("sharpe", "sortino", "volatility", "max_drawdown", "max_runup", "exposure")]),
        f"""WITH {BARS}{eq_cte}, e1 AS (SELECT *, equity/lag(equity) OVER {W} - 1 AS r, max(equity) OVER {CUM} - equity AS dd, equity - min(equity) OVER {CUM} AS ru FROM q2)
        SELECT symbol, {q6('avg(r)/nullif(stddev_pop(r),0)*sqrt(8766)')} AS sharpe, {q6('avg(r)/nullif(sqrt(avg(r*r) FILTER (r < -1e-12)),0)*sqrt(8766)')} AS sortino, {q6('stddev_pop(r)*sqrt(8766)')} AS volatility, {q6('max(dd)')} AS max_drawdown, {q6('max(ru)')} AS max_runup, {q6('avg((pos<>0)::INT)')} AS exposure FROM e1 GROUP BY symbol""",
    )
    register(
        "buy_and_hold", lambda s, d: G.buy_and_hold(event_bars(s, d)).select("symbol", *[r6(F.col(x)).alias(x) for x in ("entry_price", "exit_price", "return")]),
        f"WITH {BARS} SELECT symbol, {q6('max(open) FILTER (i=2)')} AS entry_price, {q6('arg_max(close,time)')} AS exit_price, {q6('arg_max(close,time)/nullif(max(open) FILTER (i=2),0) - 1')} AS return FROM b GROUP BY symbol",
    )
    register(
        "portfolio_union_clock", lambda s, d: G.union_clock(G.equity(held(event_bars(s, d)), 10_000.0), 10_000.0).select("time", F.round("equity", 4).alias("equity")),
        f"WITH {BARS}{eq_cte}, u1 AS (SELECT DISTINCT time FROM q2), u2 AS (SELECT u1.time, s.symbol FROM u1, (SELECT DISTINCT symbol FROM q2) s), u3 AS (SELECT u2.time, u2.symbol, coalesce(q2.equity,10000) AS e FROM u2 ASOF LEFT JOIN q2 ON q2.symbol=u2.symbol AND q2.time<=u2.time) SELECT time, round(sum(e),4) AS equity FROM u3 GROUP BY time",
    )
    register(
        "portfolio_merged_ledger", lambda s, d: G.merged_ledger(G.trades(held(event_bars(s, d)))).select("symbol", "entry_time", "exit_time", F.round("profit", 4).alias("profit"), F.round("portfolio_profit", 4).alias("portfolio_profit")),
        f"WITH {BARS}{turn_cte} SELECT symbol, entry_time, exit_time, round(profit,4) AS profit, round(sum(profit) OVER (ORDER BY exit_time, symbol, entry_time ROWS UNBOUNDED PRECEDING),4) AS portfolio_profit FROM tr",
    )
    bars_query("alerts", {}, {"message": (F.concat(F.lit("cross "), F.col("symbol")), "concat('cross ',symbol)")}, ctes=cross_cte, source=f"(SELECT * FROM s2 WHERE {over})", prepare=lambda d: smas(d).withColumn("on", ta.crossover("f", "s")).where("on"))
    register(
        "broker_backtest", lambda s, d: B.backtest(marked(event_bars(s, d)), cross_program).select("symbol", "entry_time", "exit_time", "entry_bar", "exit_bar", *[r6(F.col(x)).alias(x) for x in ("entry_price", "exit_price", "profit", "cum_profit")]),
        ORACLE_SQL["trade_ledger"],
    )
    register(
        "broker_equity", lambda s, d: B.equity_curve(marked(event_bars(s, d)), cross_program, B.Settings(initial_capital=10_000.0)).select("symbol", "time", r6(F.col("equity")).alias("equity")),
        ORACLE_SQL["equity_curve"],
    )
    register_all(register, bars_query, ORACLE_SQL, {**globals(), "sig_cte": sig_cte, "turn_cte": turn_cte, "eq_cte": eq_cte, "held": held})
    register("broker_brackets", lambda s, d: B.backtest(marked(event_bars(s, d)), bracket_program, B.Settings(commission_value=0.1, slippage=2)).drop("max_runup", "max_drawdown"))
    register("broker_summary", lambda s, d: B.summary(marked(event_bars(s, d)), bracket_program, B.Settings(qty_type="percent_of_equity", qty_value=50.0)))
    register("portfolio_shared", lambda s, d: B.shared_portfolio(marked(event_bars(s, d)), cross_program, ["click", "view", "purchase"], B.Settings(initial_capital=5_000.0)).drop("max_runup", "max_drawdown"))

    def ticks(s: SparkSession, d: str) -> DataFrame:
        return S2.stream_bars(S2.tick_stream(s, d, "events.parquet"), F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), "1 hour", "0 seconds")

    register(
        "bars_stream_vs_batch", lambda s, d: S2.replay(ticks(s, d)).select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), *[r6(F.col(x)).alias(x) for x in ohlcv]),
        f"WITH {BARS} SELECT symbol, time, {', '.join(f'{q6(x)} AS {x}' for x in ohlcv)} FROM b WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)",
    )

    def live(s: SparkSession, d: str) -> DataFrame:
        at = S2.shared_folder(s)
        event_bars(s, d).write.parquet(at)
        return S2.replay(S2.with_state(S2.tick_stream(s, at), ema=(10,)))

    register("ema_stream_vs_batch", lambda s, d: live(s, d).select("symbol", "time", r6(F.col("ema10")).alias("x")), ORACLE_SQL["ema"])
    register(
        "stream_sessions", lambda s, d: S2.replay(S2.sessions(S2.tick_stream(s, d, "events.parquet"), F.col("event_type"), F.col("ts"), F.col("value"), "30 minutes", "0 seconds")).select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "ticks", r6(F.col("total")).alias("total")),
        f"""WITH s1 AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events), s2 AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s1),
        s3 AS (SELECT event_type AS symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS ticks, {q6('sum(value)')} AS total FROM s2 GROUP BY event_type, g) SELECT * FROM s3 WHERE "end" <= (SELECT max(ts) FROM events)""",
    )
    log = lambda s, d: event_bars(s, d).select("symbol", F.row_number().over(ta.KEYS.bars()).cast("long").alias("seq"), F.lit(0).cast("long").alias("bar"), F.lit("new").alias("op"), F.row_number().over(ta.KEYS.bars()).cast("long").alias("id"), F.lit("line").alias("type"), F.create_map(F.lit("x1"), F.col("volume").cast("int").cast("string")).alias("props"))
    register("drawing_final_state", lambda s, d: D.final_state(log(s, d)).select("symbol", "type", "id", F.col("props")["x1"].alias("x1")), f"WITH {BARS}, l1 AS (SELECT symbol, row_number() OVER {W} AS id, volume::INT::VARCHAR AS x1 FROM b) SELECT symbol, 'line' AS type, id, x1 FROM l1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY id DESC) <= 50")
    bars_query("line_price", {"p": (D.line_price(F.lit(0.0), F.col("open"), F.lit(10.0), F.col("close"), F.lit(4.0)), "open + (close-open)*4/10")})
    bars_query("newest_bars", {"close": (c, "close")}, source=f"(SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 50)", prepare=lambda d: Q.bars_back(d, 50))


def _query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not QUERIES:
            _build()
        return QUERIES[name](spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in json.loads(STORED.read_text())}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in json.loads(STORED.read_text()).items() if sql is not None}


def store() -> None:
    if not QUERIES:
        _build()
    STORED.write_text(json.dumps({name: ORACLE_SQL.get(name) for name in QUERIES}, indent=1) + "\n")


if __name__ == "__main__":
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    store()
