"""Finer bars inside chart bars, for brokers that fill on them: which finer bars a chart bar has, and whether they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.security import _latest
from barframe.operators.timeframe import parse

CAP = 200_000  # fixed value: the newest finer bars of a symbol that are used
# Charts of less than so many seconds (ticks) look into bars of the timeframe; longer ones into the last.
_BELOW = ((30, "1S"), (60, "5S"), (300, "10S"), (600, "30S"), (900, "1"), (1_800, "2"), (3_600, "5"), (14_400, "10"), (86_400, "30"), (259_200, "60"), (604_800, "240"))
_BELOW_TICKS = ((100, "1T"), (1_000, "10T"))
_PRICES = ("open", "high", "low", "close")


def magnifier_timeframe(tf: str) -> str:
    """The finer timeframe of a chart's."""
    p = parse(tf)
    if p.unit == "T":
        return next((fine for n, fine in _BELOW_TICKS if p.multiplier < n), "100T")
    return next((fine for n, fine in _BELOW if p.seconds < n), "1D")


def checked(lower: DataFrame) -> DataFrame:
    """Finer bars whose fields are finite and whose prices lie within high and low; any other stops the query, as does a time that is there twice."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = finite("volume")
    for c in _PRICES:
        whole = whole & finite(c) & (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    again = F.coalesce(F.lag("time").over(Window.partitionBy("symbol").orderBy("time")) == F.col("time"), F.lit(False))
    said = F.concat(F.lit("a finer bar of "), F.col("symbol"), F.lit(" is broken or there twice: "), F.col("time").cast("string"))
    return lower.withColumn("open", F.when(whole & ~again, F.col("open")).otherwise(F.raise_error(said).cast("double")))


def magnified(bars: DataFrame, lower: DataFrame, tf: str, lower_tf: str | None = None, cap: int = CAP) -> DataFrame:
    """``bars`` with ``lower`` (the finer bars of [time, close), in order) and ``coverage``: available, cap or none.

    A bar closes a timeframe after it opens, or where the next one opens. Finer bars outside all chart bars are left out before the newest
    ``cap`` of each symbol are kept. A bar that the cap has cut has no finer bars at all, so a broker takes the bar itself.
    """
    expected = magnifier_timeframe(tf)
    if lower_tf is not None and lower_tf != expected:
        raise ValueError(f"a chart of {tf} looks into bars of {expected}, not {lower_tf}")
    w = Window.partitionBy("symbol").orderBy("time")
    ends = F.col("time") + F.expr(f"INTERVAL {parse(tf).seconds} SECONDS")
    chart = bars.withColumn("_close", F.least(ends, F.coalesce(F.lead("time").over(w), ends)))
    side = checked(lower).select("symbol", F.col("time").alias("_key"), *_PRICES)
    spans = chart.select("symbol", F.col("time").alias("_key"), F.col("time").alias("_bar"), "_close")
    inside = _latest(side, spans, ["symbol"], ["_bar", "_close"], False, ["symbol", "_key", *_PRICES]).where(F.col("_key") < F.col("_close"))
    newest = inside.withColumn("_kept", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("_key"))) <= cap)
    held = newest.groupBy("symbol", "_bar").agg(
        F.array_sort(F.collect_list(F.struct("_key", *_PRICES))).alias("_all"), F.bool_and("_kept").alias("_whole"),
    )
    held = held.select(F.col("symbol").alias("_s"), F.col("_bar").alias("_b"), F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in _PRICES])).alias("_lower"), "_whole")
    got = chart.join(held, (F.col("symbol") == F.col("_s")) & (F.col("time") == F.col("_b")), "left")
    none = F.array().cast("array<struct<open:double,high:double,low:double,close:double>>")
    return got.select(
        *bars.columns, F.when(F.col("_whole"), F.col("_lower")).otherwise(none).alias("lower"),
        F.when(F.col("_whole"), "available").when(F.col("_whole").isNotNull(), "cap").otherwise("none").alias("coverage"),
    )
