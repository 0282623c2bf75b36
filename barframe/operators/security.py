"""Multi-timeframe and cross-symbol requests: resampling and the alignments of another bar table with the chart's.

``expr`` functions take a bar table and add the requested columns to it, so any indicator runs on the requested bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.na import col
from barframe.operators.timeframe import bucket, parse

Expr = Callable[[DataFrame], DataFrame]


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Bars of a longer timeframe with their bucket number; a partial and a final aggregate, one exchange."""
    return (
        bars.groupBy("symbol", bucket("time", tf).alias("bucket"))
        .agg(
            F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"), F.min("time").alias("time"),
        )
        .select("symbol", "time", "open", "high", "low", "close", "volume", "bucket")
    )


def security(bars: DataFrame, tf: str, expr: Expr, out: list[str], chart_tf: str = "60", lookahead: bool = False, gaps: bool = False) -> DataFrame:
    """``bars`` with the columns ``out`` of the same symbol's longer timeframe.

    Without lookahead a bar sees the period before its own (its own if ``tf`` is not longer than the chart's); with it, its
    own period's final value. With gaps only the first bar of a period has the value.
    """
    higher = expr(resample(bars, tf))
    w = Window.partitionBy("symbol").orderBy("bucket")
    late = not lookahead and parse(tf).seconds > parse(chart_tf).seconds
    side = higher.select(F.col("symbol").alias("_s"), F.col("bucket").alias("_b"), *[(F.lag(c).over(w) if late else F.col(c)).alias(c) for c in out])
    chart = bars.withColumn("_bucket", bucket("time", tf))
    got = chart.join(side, (F.col("symbol") == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    if gaps:
        k = Window.partitionBy("symbol").orderBy("time")
        new = F.coalesce(F.col("_bucket") != F.lag("_bucket").over(k), F.lit(True))
        got = got.withColumns({c: F.when(new, F.col(c)) for c in out})
    return got.select(*bars.columns, *out)


def _latest(chart: DataFrame, side: DataFrame, by: list[str], out: list[str], strict: bool, columns: list[str]) -> DataFrame:
    """For every chart row the last side row whose key is not above (strict: is under) its own: one union, one sorted pass."""
    value = F.struct(*[F.col(c) for c in out])
    a = chart.select(*[F.col(b) for b in by], F.col("_key"), F.lit(0 if strict else 1).alias("_tag"), F.lit(None).cast(side.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.struct(*columns).alias("_row"))
    b = side.select(*[F.col(x) for x in by], F.col("_key"), F.lit(1 if strict else 0).alias("_tag"), value.alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_key", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    return both.select(*[F.col("_row")[c].alias(c) for c in columns], *[F.col("_last")[c].alias(c) for c in out])


def injected(bars: DataFrame, side: DataFrame, out: list[str], tf: str, chart_tf: str = "60", lookahead: bool = False) -> DataFrame:
    """Same symbol, bars given from outside: the last that closed by the chart bar's close (with lookahead: opened by its open)."""
    k = Window.partitionBy("symbol").orderBy("time")
    close = lambda t: F.coalesce(F.lead("time").over(k), F.col("time") + F.expr(f"INTERVAL {parse(t).seconds} SECONDS"))
    key = (lambda t: F.col("time")) if lookahead else close
    return _latest(bars.withColumn("_key", key(chart_tf)), side.withColumn("_key", key(tf)), ["symbol"], out, False, bars.columns)


def cross_symbol(bars: DataFrame, other: DataFrame, tf: str, expr: Expr, out: list[str], chart_tf: str = "60", lookahead: bool = False) -> DataFrame:
    """Another symbol's columns by period: strictly before the bar's own without lookahead in a longer timeframe, else up to it.

    ``other`` holds one symbol's bars, which every chart symbol sees: the periods that the chart has are looked up once, then joined.
    """
    strict = not lookahead and parse(tf).seconds > parse(chart_tf).seconds
    side = expr(resample(other, tf)).select(F.lit(0).alias("_one"), F.col("bucket").alias("_key"), *out)
    chart = bars.withColumn("_period", bucket("time", tf))
    periods = chart.select(F.lit(0).alias("_one"), F.col("_period").alias("_key")).distinct().withColumn("_at", F.col("_key"))
    seen = _latest(periods, side, ["_one"], out, strict, ["_at"])
    return chart.join(seen, F.col("_period") == F.col("_at"), "left").select(*bars.columns, *out)


def lower_timeframe(bars: DataFrame, lower: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Arrays of the lower bars' values in [bar, next bar); no such bars give empty arrays. Lower bars before the first bar are left out."""
    chart = bars.withColumn("_key", F.col("time"))
    side = lower.select("symbol", F.col("time").alias("_key"), *[v.cast("double").alias(n) for n, v in exprs.items()])
    of = _latest(side, bars.select("symbol", F.col("time").alias("_key"), F.col("time").alias("_bar")), ["symbol"], ["_bar"], False, ["symbol", "_key", *exprs])
    kept = of.where(F.col("_bar").isNotNull()).groupBy("symbol", F.col("_bar").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("_key", *exprs))).alias("_all"))
    got = chart.join(kept.withColumnRenamed("symbol", "_s"), (F.col("symbol") == F.col("_s")) & (chart["_key"] == kept["_key"]), "left")
    none = F.array().cast("array<double>")
    return got.select(*bars.columns, *[_values(n, none) for n in exprs])


def _values(name: str, none: Column) -> Column:
    return F.coalesce(F.transform("_all", lambda r: r[name]), none).alias(name)


def bars_back(bars: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("time"))
    return bars.withColumn("_n", F.row_number().over(w)).where(col("_n") <= cap).drop("_n")
